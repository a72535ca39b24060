"""Training-data operators: ten document, url and vector stages and their queries."""
