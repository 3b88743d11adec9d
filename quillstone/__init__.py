"""quillstone: a PySpark-native engine for learning content and training corpora."""
