"""Training-data operators (texts, URLs, vectors, archives). Nothing outside this folder imports it."""
