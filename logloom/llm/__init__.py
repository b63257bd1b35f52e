"""Operations of a training-data pipeline over corpora of documents (nothing else in the library imports this)."""
