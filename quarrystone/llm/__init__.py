"""Training-data operators: de-duplication, filters, extraction and mixing.  Nothing else in the library imports them."""
