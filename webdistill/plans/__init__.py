"""Ready-made queries over tables of pages, and their SQL."""
