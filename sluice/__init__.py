"""Request triage over Spark DataFrames: masking, labelling, contract checks, corrections, evaluation."""
