"""Grounded text extraction on Spark: documents to chunks, prompts, model output,
validated extractions and byte spans, as DataFrame operators."""
