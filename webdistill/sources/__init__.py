"""Sources of pages: bytes and their encodings, tables and folders of files."""
