"""Text built from profile relations: reports, summaries and context blocks."""
