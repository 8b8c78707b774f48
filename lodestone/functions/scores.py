"""Scores of freshness, repositories, sources, paths and candidates; formulas with fixed weights."""

from __future__ import annotations

from .dialect import Spark
from .text import any_word, txt, yearish


def freshness(d: Spark, date: str, year: int = 2026) -> str:
    """By age in years: up to 1, 3, 6 and more; future dates are fresh, no date is in between."""
    age = f"greatest(0, {year} - {yearish(d, date)})"
    return f"case when {yearish(d, date)} is null then 0.45e0 when {age} <= 1 then 1e0 when {age} <= 3 then 0.82e0 when {age} <= 6 then 0.6e0 else 0.35e0 end"


def repo_health(d: Spark, stars: str, forks: str, licence: str, last_commit: str, issues: str) -> str:
    recent = d.matches(txt(last_commit), "20(?:2[4-9]|3[0-9])")
    total = (
        f"0.25e0 + least(0.25e0, coalesce({stars}, 0) / 5000e0) + least(0.15e0, coalesce({forks}, 0) / 1000e0)"
        f" + case when {txt(licence)} <> '' then 0.15e0 else 0e0 end + case when {recent} then 0.15e0 else 0.05e0 end - least(0.15e0, coalesce({issues}, 0) / 2000e0)"
    )
    return f"least(1e0, greatest(0e0, {total}))"


#: Words that tell an issue's risk, by signal.
ISSUE_RISKS = {
    "bug_or_regression": ("bug", "regression", "broken", "failure"),
    "installation_risk": ("install", "setup", "dependency"),
    "security_risk": ("security",),
}


def issue_risks(d: Spark, text: str) -> str:
    """The risk signals of an issue, joined by commas; ``text`` is its labels, title and body."""
    flags = ", ".join(f"case when {any_word(d, f'lower({txt(text)})', words)} then '{name}' end" for name, words in ISSUE_RISKS.items())
    return f"concat_ws(',', {flags})"


#: Base scores of the kinds of sources, and tiers.
SOURCE_BASE = {
    "api_metadata": 0.9, "paper_full_text": 0.88, "official_repo_readme": 0.82, "official_repo_docs": 0.78, "repo_release": 0.7, "repo_issue": 0.55,
    "model_or_dataset_card": 0.74, "blog_post": 0.45, "llm_inferred": 0.2, "sample_fixture": 0.8, "unknown": 0.5,
}
TIERS = ((0.82, "high"), (0.62, "medium"), (0.4, "low"))


def source_type(d: Spark, *, name: str, method: str, kind: str, section: str, url: str, span: str) -> str:
    """The kind of source; the first rule that holds decides."""
    s, u = f"lower({txt(section)})", f"lower({txt(url)})"
    rules = (
        (f"{txt(method)} = 'llm' and not {span}", "llm_inferred"),
        (f"{txt(name)} = 'sample'", "sample_fixture"),
        (any_word(d, u, ("medium.com", "substack.com", "dev.to", "blog")), "blog_post"),
        (f"{txt(kind)} = 'Issue' or {s} = 'issue'", "repo_issue"),
        (f"{txt(kind)} = 'Release' or contains({s}, 'release')", "repo_release"),
        (f"{txt(kind)} = 'RepoDocument' and {s} = 'readme'", "official_repo_readme"),
        (f"{txt(kind)} = 'RepoDocument' or {s} in ('docs', 'changelog')", "official_repo_docs"),
        (f"{txt(kind)} in ('Model', 'Dataset') or contains({txt(name)}, 'huggingface')", "model_or_dataset_card"),
        (f"{txt(kind)} = 'Paper' and {s} in ('abstract', 'paper_full_text', '')", "paper_full_text"),
        (f"{txt(method)} = 'api'", "api_metadata"),
    )
    return "case " + " ".join(f"when {c} then '{r}'" for c, r in rules) + " else 'unknown' end"


def source_score(d: Spark, kind: str, *, method: str, span: str, claim: str) -> str:
    """The score of a kind of source: less for model extractions, little without a span, more for issues on risk."""
    base = "case " + kind + " " + " ".join(f"when '{k}' then {v}e0" for k, v in SOURCE_BASE.items()) + " else 0.5e0 end"
    after = f"({base} - case when {txt(method)} = 'llm' and {kind} <> 'llm_inferred' then 0.08e0 else 0e0 end)"
    capped = f"case when not {span} and {txt(method)} <> 'api' then least({after}, 0.25e0) else {after} end"
    return f"round(least(1e0, greatest(0e0, {capped} + case when {txt(claim)} in ('repo_risk', 'limitation') and {kind} = 'repo_issue' then 0.08e0 else 0e0 end)), 3)"


def tier(score: str) -> str:
    return "case " + " ".join(f"when {score} >= {at}e0 then '{name}'" for at, name in TIERS) + " else 'weak' end"


def path_quality(length: str, claim: str, span: str) -> str:
    """Quality of a path of ``length`` nodes all of whose hops are typed; a single node has no hop."""
    factor = f"case when {length} <= 4 then 1e0 else greatest(0.35e0, 1e0 - ({length} - 4) * 0.1e0) end"
    return f"round(least(1e0, 0.7e0 * ({factor}) * case when {length} > 1 then 1e0 else 0e0 end + case when {claim} then 0.15e0 else 0e0 end + case when {span} then 0.15e0 else 0e0 end), 4)"


#: Weights of a candidate's features.
WEIGHTS = {"semantic": 0.2, "lexical": 0.15, "path_quality": 0.15, "source_quality": 0.1, "freshness": 0.07, "confidence": 0.08, "evidence": 0.09, "path_score": 0.08, "rrf": 0.05, "diversity": 0.03}


def combined(**features: str) -> str:
    """The weighted sum of features cut to 0..1; features left out count 0. Not rounded."""
    return "(" + " + ".join(f"{WEIGHTS[k]}e0 * least(1e0, greatest(0e0, {v}))" for k, v in features.items()) + ")"


#: Weights of edge types in a path's score.
EDGE_WEIGHTS = {
    "CLAIMS": 0.95, "SUPPORTED_BY": 0.95, "IMPLEMENTS": 0.88, "INTRODUCES": 0.86, "USES_METHOD": 0.78, "BELONGS_TO_COMMUNITY": 0.74, "EVALUATES_ON": 0.82,
    "HAS_CHUNK": 0.72, "MENTIONS": 0.66, "CITES": 0.64, "SIMILAR_TO": 0.52, "CONTRADICTS": 0.58, "POSSIBLE_DUPLICATE": 0.25,
}


def edge_weight(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when '{k}' then {v}e0" for k, v in EDGE_WEIGHTS.items()) + " else 0.45e0 end"


def hop_score(kind: str, confidence: str, quality: str) -> str:
    return f"0.45e0 * {edge_weight(kind)} + 0.35e0 * coalesce({confidence}, 0.65e0) + 0.2e0 * coalesce({quality}, 0.55e0)"


def length_penalty(length: str) -> str:
    return f"greatest(0.72e0, 1e0 - 0.04e0 * greatest(0, {length} - 4))"


def evidence_strength(d: Spark, labels: str) -> str:
    parts = (("Claim", 0.22), ("DocumentChunk", 0.2), ("Repo", 0.12))
    data = f"case when {d.has(labels, chr(39) + 'Benchmark' + chr(39))} or {d.has(labels, chr(39) + 'Dataset' + chr(39))} then 0.11e0 else 0e0 end"
    return "least(1e0, 0.35e0 + " + " + ".join(f"case when {d.has(labels, chr(39) + n + chr(39))} then {v}e0 else 0e0 end" for n, v in parts) + f" + {data})"
