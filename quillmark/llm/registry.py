"""The modules of this subpackage that have queries."""

MODULES = ["quillmark.llm.neardup", "quillmark.llm.origin", "quillmark.llm.parsing", "quillmark.llm.residue", "quillmark.llm.secrets", "quillmark.llm.splits", "quillmark.llm.tokens", "quillmark.llm.packing"]
