"""Evidence-ranked candidate discovery on Spark: candidate selection, ranking, similarity search, curation."""
