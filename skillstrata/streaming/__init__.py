"""The same cleaning on a stream of postings."""
