"""Column functions: text in, arrays of tokens, sentences, chunks and spans out."""
