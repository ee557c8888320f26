"""Operations of a pipeline for training text."""
