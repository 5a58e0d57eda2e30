"""Training-data operators: chat, line, page, document and corpus level.

Nothing outside this package imports it; its queries are registered in
``glosa.llm.queries`` and ``corpus_pipeline.py``.
"""
