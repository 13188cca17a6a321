"""PySpark-native document retrieval and question answering over chunked corpora."""
