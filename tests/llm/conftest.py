from llm.conftest_llm import awkward, no_docs  # noqa: F401
