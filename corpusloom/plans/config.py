"""Settings: defaults, then file, environment and command line. Values enter plans as literals."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from typing import Any

# Settings and their defaults.
DEFAULTS: dict[str, Any] = {
    "paths": {"pdf_dir": "pdfs", "cache_dir": ".rag_cache", "crossref_email": None},
    "indexing": {"page_split": "sliding", "window_chars": 600, "overlap_chars": 80, "text_quality_check": True, "min_readable_ratio": 0.5},
    "bm25": {"k1": 1.4, "b": 0.75, "build_top_k": 300, "pool_size": 200, "token_pattern": "[A-Za-z0-9]+"},
    "llm": {"enabled": False, "n": 5, "use_for_bm25": True, "use_for_semantic": False, "provider": "openai", "model": None, "base_url": None, "temperature": 0.7, "max_tokens": 256, "summary": {"enabled": False, "top_k": 25, "max_tokens": 10000}},
    "prf": {"enabled": False, "fb_docs": 6, "fb_terms": 10, "alpha": 0.6},
    "bonuses": {"proximity": {"enabled": True, "window": 24, "weight": 0.2}, "ngram": {"enabled": True, "weight": 0.1}},
    "diversity": {"enabled": True, "per_doc_penalty": 0.3, "max_per_doc": 2, "mmr": {"enabled": True, "lambda": 0.7}},
    "rerank": {"heuristic": {"enabled": True, "topn": 150, "alpha": 0.6, "beta": 0.3, "gamma": 0.1}, "semantic": {"enabled": False, "topn": 80, "ann": {"enabled": False, "topn": 200}}, "final_top_k": 8},
    "fusion": {"rrf": {"enabled": True, "C": 75, "cap": 200}, "robust_query": {"enabled": True}},
    "citations": {"crossref": True, "openalex": True, "unpaywall": False, "cache_seconds": 604800, "bibliography_index_path": None, "prefer_bibliography": True, "drop_unknown": True, "include_pandoc_cite": True, "pandoc_as_primary": True},
    "output": {"max_snippet_chars": 900, "pretty_json": True, "include_scores": True},
    "performance": {"api_semaphore_size": 5, "pdf_thread_workers": None, "deterministic": True},
    "mode": "reference",
}

# Environment variables and what they set.
ENVIRONMENT = {
    "RAG_PATHS_PDF_DIR": "paths.pdf_dir",
    "RAG_PATHS_CACHE_DIR": "paths.cache_dir",
    "RAG_PATHS_CROSSREF_EMAIL": "paths.crossref_email",
    "RAG_BM25_K1": "bm25.k1",
    "RAG_BM25_B": "bm25.b",
    "RAG_PRF_ENABLED": "prf.enabled",
    "RAG_PRF_FB_DOCS": "prf.fb_docs",
    "RAG_PRF_FB_TERMS": "prf.fb_terms",
    "RAG_RERANK_FINAL_TOP_K": "rerank.final_top_k",
}


def defaults() -> dict[str, Any]:
    return copy.deepcopy(DEFAULTS)


def merge(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """A new dictionary; nested dictionaries are merged, anything else of `over` wins. Neither argument is changed."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def put(cfg: dict[str, Any], dotted: str, value: Any) -> None:
    *path, last = dotted.split(".")
    for k in path:
        cfg = cfg.setdefault(k, {})
    cfg[last] = value


def look(cfg: dict[str, Any], dotted: str) -> Any:
    for k in dotted.split("."):
        cfg = cfg.get(k) if isinstance(cfg, dict) else None
    return cfg


def with_environment(cfg: dict[str, Any], env: dict[str, str] | None = None) -> dict[str, Any]:
    out, env = copy.deepcopy(cfg), os.environ if env is None else env
    for name, dotted in ENVIRONMENT.items():
        if name in env:
            now, value = look(out, dotted), env[name]
            if isinstance(now, bool):
                value = value.lower() in ("true", "1", "yes", "on")
            elif isinstance(now, (int, float)):
                value = type(now)(value)
            put(out, dotted, value)
    return out


def load(path: str | None = None, overrides: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> dict[str, Any]:
    """Defaults, the JSON or (if a YAML reader is installed) YAML file, the environment, then dotted overrides that aren't None."""
    cfg = defaults()
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            read = json.loads(text)
        except ValueError:
            import yaml  # optional

            read = yaml.safe_load(text)
        cfg = merge(cfg, read or {})
    cfg = with_environment(cfg, env)
    for dotted, value in (overrides or {}).items():
        if value is not None:
            put(cfg, dotted, value)
    return cfg


def surroundings(env: dict[str, str] | None = None) -> str:
    """Where the process runs: 'ci', 'docker', 'codespace' or 'local'."""
    env = dict(os.environ) if env is None else env
    if env.get("CODESPACES"):
        return "codespace"
    if env.get("CI") or env.get("GITHUB_ACTIONS"):
        return "ci"
    return "docker" if os.path.exists("/.dockerenv") or env.get("DOCKER_CONTAINER") else "local"


def adapted(cfg: dict[str, Any], where: str) -> dict[str, Any]:
    """cfg with paths made whole and the number of requests at once fitted to where it runs."""
    out = copy.deepcopy(cfg)
    for key in ("pdf_dir", "cache_dir"):
        out["paths"][key] = os.path.expanduser(out["paths"][key])
    if where in ("ci", "codespace"):
        out["performance"]["api_semaphore_size"] = min(out["performance"]["api_semaphore_size"], 2)
    return out


def chunking_hash(cfg: dict[str, Any] | None) -> str:
    """Changes whenever the cut of pages into chunks does; no settings and empty settings are the same."""
    return hashlib.sha256(json.dumps(cfg or {}, sort_keys=True).encode()).hexdigest()
