"""DataFrame -> DataFrame operators of the variant / answer-grading workflow."""
