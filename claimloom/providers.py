"""Interfaces to models, embedders and citation services, with deterministic offline versions."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.vectors import word_hash
from claimloom.operators.extract import arxiv_id, atom_feed
from claimloom.operators.vote import vote_scalar
from claimloom.plans.ship import ship


class Model(Protocol):
    """Answers a prompt with text; must be picklable, as it runs on the workers.

    ``task`` says what for: extract, extract_code, fix, reduce, judge, score, spec,
    align, rubric or blueprint.
    """

    def __call__(self, prompt: str, sample: int = 0, task: str = "extract") -> str: ...


class OfflineModel:
    """Answers every task by rule: the same prompt gives the same reply."""

    def __call__(self, prompt: str, sample: int = 0, task: str = "extract") -> str:
        return json.dumps(getattr(self, f"_{task}")(prompt or ""))

    @staticmethod
    def _title(text: str) -> str:
        return " ".join(text.split()[:6]).strip(".?!,;:")

    def _extract(self, prompt: str) -> dict:
        sentences = [s.strip() for s in re.split(r"(?<=[.?!])\s+", prompt) if s.strip()]
        if not sentences:
            return {}
        t = self._title
        directions = [{"name": t(s), "type": "method", "context": s, "W3_approaches": [{"name": f"{t(s)} approach", "type": "method", "context": s}]} for s in sentences[1:3]]
        return {"W1_problem": {"name": t(sentences[0]), "type": "problem", "context": sentences[0]}, "W2_directions": directions}

    def _extract_code(self, prompt: str) -> dict:
        named = [line[2:].partition(": ") for line in prompt.rpartition("--- approaches ---\n")[2].split("\n") if line.startswith("- ")]
        code = lambda name, text: [{"name": f"{name} code", "type": "component", "context": text, "code_ref": "main.py", "code_body": "def run(x):\n    return x"}]
        return {"W4_implementations": [{"name": f"{name} built", "type": "solution", "context": text, "parent_W3_id": name, "W5_code": code(name, text)} for name, _, text in named]}

    def _fix(self, prompt: str) -> dict:
        missing = [m[1] for m in re.finditer(r"error \[R6\] (\S+?): ", prompt)]
        bare = [m[1].split("->", 1) for m in re.finditer(r"error \[R3\] (\S+?): ", prompt) if "->" in m[1]]
        rho = {"bottleneck": "unknown", "mechanism": "unknown", "tradeoff": "unknown", "confidence": 0.5}
        return {"fixes": [{"action": "update_atom", "node_id": x, "provenance": {"code_span": "text"}} for x in missing] + [{"action": "update_edge", "src": s, "tgt": t, "rho": rho} for s, t in bare]}

    def _reduce(self, prompt: str) -> dict:
        rows = [json.loads(line) for line in prompt.split("\n")[1:] if line.startswith("{") and line.endswith("}")]
        if not rows:
            return {}
        return {"reduced_atoms": [{"name": f"{rows[0].get('name', '')} and like", "type": rows[0].get("type"), "context": " ".join(r.get("context", "") for r in rows)[:500]}]}

    def _judge(self, prompt: str) -> dict:
        rows = [json.loads(line) for line in prompt.split("\n") if line.startswith("{") and line.endswith("}")]
        return {"merge": len(rows) > 1, "canonical_name": rows[0].get("name") if rows else None, "canonical_type": rows[0].get("type") if rows else None, "canonical_context": rows[0].get("context") if rows else None, "reasoning": "alike"}

    def _score(self, prompt: str) -> dict:
        m = re.search(r"\d+\.\d+", prompt)
        return {"score": float(m[0]) if m else None}

    def _spec(self, prompt: str) -> dict:
        return {"verdict": "compliant" if "assert" in prompt else "violates_spec"}

    def _align(self, prompt: str) -> dict:
        return {"verdict": "aligned" if "return" in prompt else "partially_aligned" if "if " in prompt else "misaligned"}

    def _blueprint(self, prompt: str) -> dict:
        sentences = [s.strip() for s in re.split(r"(?<=[.?!])\s+", prompt) if s.strip()]
        names = [self._title(s) for s in sentences]
        return {"atoms": [{"name": n, "type": "method", "context": s} for n, s in zip(names, sentences, strict=True)], "edges": [{"src": a, "relation": "RELATED_TO", "tgt": b} for a, b in zip(names, names[1:], strict=False)]}

    def _rubric(self, prompt: str) -> dict:
        far = [m[1] for m in re.finditer(r"^(\S+) distance ([0-9.]+)", prompt, re.M) if float(m[2]) >= 0.5]
        return {"divergence_points": far, "dimension_scores": {}, "recommendation": "differs" if far else "close to known work"}


def ask(prompts: DataFrame, key: str, model: Model | None = None, k: int = 1, task: str = "extract") -> DataFrame:
    """(key, sample, reply): ``k`` replies per prompt, asked where the rows are; a failing call gives no reply."""
    model = model or OfflineModel()
    kind = dict(prompts.dtypes)[key]
    ship(prompts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, prompt in zip(b[key], b["prompt"], strict=True):
                for i in range(k):
                    try:
                        rows.append((x, i, model(prompt, i, task)))
                    except Exception:  # noqa: BLE001 - a failed sample is left out of the vote
                        continue
            if rows:
                yield pd.DataFrame(rows, columns=[key, "sample", "reply"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, sample int, reply string")


def verdicts(prompts: DataFrame, key: str, task: str, field: str, model: Model | None = None, k: int = 1) -> DataFrame:
    """(key, ``field``): the most frequent value of a field of ``k`` replies, ties to the first; prompts without any reply are left out."""
    said = ask(prompts, key, model, k, task).select(key, "sample", F.get_json_object("reply", f"$.{field}").alias(field))
    return vote_scalar(said, [key], field, [F.col("sample")]).select(key, field)


def embed(text: Column, instruction: str | None = None, dim: int = 128) -> Column:
    """Offline embedding of ``text``, with the instruction before it if there is one."""
    return word_hash(text if instruction is None else F.concat(F.lit(f"{instruction}: "), text), dim)


def with_retry(call: Callable, tries: int = 3, pause: float = 0.5, gap: float = 0.0) -> Callable:
    """``call`` with growing pauses between tries and at least ``gap`` seconds between calls of one worker."""
    last = [0.0]

    def run(*args):
        for i in range(tries):
            time.sleep(max(0.0, last[0] + gap - time.monotonic()))
            last[0] = time.monotonic()
            try:
                return call(*args)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(pause * 2**i)

    return run


# Citation services in the order they are asked, and the confidence of a hit.
SERVICES = {"semantic_scholar": 0.9, "arxiv": 0.85, "openalex": 0.75, "crossref": 0.7}
#: Confidence of an arXiv hit that was found by title.
ARXIV_BY_TITLE = 0.6
#: Characters of a citation that a service is asked with, and authors that are kept of a hit.
QUERY_CHARS = {"semantic_scholar": 256, "arxiv": 200, "openalex": 256, "crossref": 256}
AUTHORS = 5

# The parts of the services' replies that are read.
REPLIES = {
    "semantic_scholar": "struct<data: array<struct<title: string, authors: array<struct<name: string>>, year: int, venue: string, externalIds: struct<DOI: string>>>>",
    "openalex": "struct<results: array<struct<title: string, doi: string, authorships: array<struct<author: struct<display_name: string>>>, publication_year: int, primary_location: struct<source: struct<display_name: string>>>>>",
    "crossref": "struct<message: struct<items: array<struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string>>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>>>>>",
}


def service_query(service: str, raw: Column) -> Column:
    """What a service is asked for a citation: its arXiv id where there is one, else its first characters."""
    text = F.substring(F.trim(raw), 1, QUERY_CHARS[service])
    if service != "arxiv":
        return text
    found = arxiv_id(raw)
    return F.when(found != "", F.concat(F.lit("id_list="), found)).otherwise(F.concat(F.lit("ti:"), F.replace(text, F.lit(" "), F.lit("+"))))


def service_hit(service: str, raw: Column, reply: Column) -> Column:
    """A service's reply as (doi, title, authors, year, venue, confidence); null if it has no hit."""
    first = lambda c: F.get(c, F.lit(0))
    names = lambda c, f: F.slice(F.coalesce(F.transform(c, f), F.array().cast("array<string>")), 1, AUTHORS)
    none = F.lit(None).cast("string")
    sure = F.lit(SERVICES[service])
    if service == "arxiv":
        title, _, year, authors, _ = atom_feed(reply)
        ok = F.coalesce(reply.contains("<entry>"), F.lit(False))
        parts = (none, F.nullif(title, F.lit("")), F.slice(authors, 1, AUTHORS), year, F.lit("arXiv"), F.when(arxiv_id(raw) != "", sure).otherwise(ARXIV_BY_TITLE))
    else:
        r = F.from_json(reply, REPLIES[service])
        if service == "semantic_scholar":
            x = first(r["data"])
            parts = (x["externalIds"]["DOI"], x["title"], names(x["authors"], lambda a: a["name"]), x["year"], x["venue"], sure)
        elif service == "openalex":
            x = first(r["results"])
            doi = F.nullif(F.replace(x["doi"], F.lit("https://doi.org/"), F.lit("")), F.lit(""))
            parts = (doi, x["title"], names(x["authorships"], lambda a: a["author"]["display_name"]), x["publication_year"], x["primary_location"]["source"]["display_name"], sure)
        else:
            x = first(r["message"]["items"])
            parts = (x["DOI"], first(x["title"]), names(x["author"], lambda a: F.trim(F.concat_ws(" ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit(""))))), first(first(x["issued"]["date-parts"])), first(x["container-title"]), sure)
        ok = x.isNotNull()
    hit = F.struct(*[p.alias(n) for p, n in zip(parts, ("doi", "title", "authors", "year", "venue", "confidence"), strict=True)])
    return F.when(ok, hit)


def resolve_replies(citations: DataFrame, raw: str = "raw_citation") -> DataFrame:
    """Adds ``resolved``: of the services' replies (a column per service, null where it wasn't reached) the first hit in order, with source_api.

    A blank citation isn't resolved.
    """
    hits = [F.when(service_hit(s, F.col(raw), F.col(s)).isNotNull(), F.struct(F.lit(s).alias("source_api"), service_hit(s, F.col(raw), F.col(s)).alias("hit"))) for s in SERVICES if s in citations.columns]
    first = F.when(F.trim(raw) != "", F.coalesce(*hits))
    flat = F.when(first.isNotNull(), F.struct(first["source_api"].alias("source_api"), *[first["hit"][n].alias(n) for n in ("doi", "title", "authors", "year", "venue", "confidence")]))
    return citations.withColumn("resolved", flat)


def resolve_citations(raw: DataFrame, catalogues: dict[str, DataFrame]) -> DataFrame:
    """(cite_id, source_api, title, confidence): first service in order that knows a citation's key.

    Every catalogue is (key, title), one row per key; one left join each.
    """
    out = raw
    for name in SERVICES:
        if name in catalogues:
            out = out.join(catalogues[name].select(F.col("key").alias("cite_key"), F.col("title").alias(f"t_{name}")), "cite_key", "left")
    known = [n for n in SERVICES if n in catalogues]
    first = F.coalesce(*[F.when(F.col(f"t_{n}").isNotNull(), F.struct(F.lit(n).alias("source_api"), F.col(f"t_{n}").alias("title"), F.lit(SERVICES[n]).alias("confidence"))) for n in known])
    return out.select("cite_id", first.alias("f")).select("cite_id", "f.source_api", "f.title", "f.confidence")
