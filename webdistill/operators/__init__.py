"""DataFrame operators over tables of pages."""
