"""Training-data operators over text and page tables. Nothing else in the library imports this subpackage."""
