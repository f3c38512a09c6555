"""Operators for preparing training data. Each module holds one operator with
its own general interface; :mod:`agentlake.llm.queries` applies them to whole
tables. Nothing outside this folder imports it."""
