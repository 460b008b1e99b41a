"""Training-data operators: filtering, dedup, tokenising, packing, archiving and scoring of text."""
