"""corpusmill: document-corpus analytics and question answering on PySpark."""
