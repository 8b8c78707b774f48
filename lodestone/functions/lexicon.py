"""Lexicons of extraction (fixed values): methods with aliases and category, benchmark, dataset, claim and polarity words."""

from __future__ import annotations

#: The general lexicon.
METHODS = (
    ("GraphRAG", ("graphrag", "graph retrieval augmented generation", "graph rag"), "graph-aware retrieval"),
    ("Text2Cypher", ("text2cypher", "text-to-cypher", "natural language to cypher"), "structured graph query"),
    ("Agent Memory", ("agent memory", "long-term memory agents", "memory augmented agents", "agentic memory"), "agent architecture"),
    ("Hybrid Retrieval", ("hybrid retrieval", "vector plus keyword", "vector and full-text"), "retrieval"),
    ("Community Detection", ("community detection", "louvain", "leiden", "graph clustering"), "graph analytics"),
    ("RAG Evaluation", ("rag evaluation", "ragas", "faithfulness", "context recall"), "evaluation"),
    ("Query Decomposition", ("query decomposition", "subquestions", "drift search", "broad-to-local search"), "retrieval orchestration"),
)
#: The lexicon of the project's test corpus, whose methods are its tasks.
CORPUS_METHODS = (
    ("Claim Checking", ("claim checking", "verifier"), "evaluation"),
    ("Entity Linking", ("entity linking", "linker"), "graph analytics"),
    ("Evidence Tracing", ("evidence tracing", "trace"), "graph analytics"),
    ("Memory Pruning", ("memory pruning", "long-term recall"), "agent architecture"),
    ("Question Answering", ("question answering", "reader"), "retrieval"),
    ("Source Ranking", ("source ranking", "reranker"), "retrieval"),
    ("Summary Planning", ("summary planning", "report drafting"), "agent architecture"),
    ("Table Lookup", ("table lookup", "schema"), "structured graph query"),
    ("RAG Evaluation", ("rag evaluation", "faithfulness", "context recall"), "evaluation"),
)
BENCHMARKS = (
    ("benchmark", "Benchmark", "retrieval_quality", "benchmark"),
    ("leaderboard", "Leaderboard", "leaderboard", "ranking"),
    ("faithfulness", "Faithfulness", "rag_evaluation", "faithfulness"),
    ("context recall", "Context Recall", "rag_evaluation", "context_recall"),
    ("answer relevance", "Answer Relevance", "rag_evaluation", "answer_relevance"),
)
DATASETS = (("dataset", "Research Dataset", "ai_research"), ("corpus", "Research Corpus", "ai_research"), ("knowledge base", "Knowledge Base", "knowledge_graph"))
CLAIM_WORDS = ("benchmark", "dataset", "evaluation", "improve", "outperform", "risk", "limitation", "challenge", "production", "evidence", "retrieval", "memory")
CAUTION_WORDS = ("risk", "limitation", "challenge", "fails", "stale", "broken")
POSITIVE_WORDS = ("improve", "outperform", "strong", "effective", "production", "useful")
CLAIM_CONFIDENCE = {"Paper": 0.8, "Repo": 0.72, "RepoDocument": 0.72, "Release": 0.68, "Issue": 0.58, "Model": 0.7, "Dataset": 0.72}
STOP_TERMS = ("with", "from", "that", "this", "uses", "using", "into", "over", "when", "should", "source")
