"""Operations of a training-data pipeline: classifiers, near duplicates, filters, search, mixing, decontamination, LM scores."""
