"""Integrity audit: which checks an atom needs, their verdicts, and the report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import providers
from claimloom.functions.json import merged
from claimloom.ontology import PASSED_OVER_BY_AUDIT, TYPE_CHECKS, lookup
from claimloom.plans.lineage import cut
from claimloom.schema import with_provenance


def dispatch(atoms: DataFrame) -> DataFrame:
    """(node_id, type, status, check, action): audit, skip (status kept) or mark skipped."""
    check = lookup(F.col("type"), TYPE_CHECKS)
    action = F.when(F.col("status").isin(PASSED_OVER_BY_AUDIT), "passed_over").when(check.isNull(), "skipped").otherwise("audited")
    return atoms.select("node_id", "type", "status", check.alias("check"), action.alias("action"))


def audited(atoms: DataFrame) -> DataFrame:
    """The atoms that an audit takes: those of status active, so that nothing is checked twice."""
    return atoms.where(F.col("status") == "active")


def i1_tolerance(score: Column, std: Column) -> Column:
    """1 % of the score, or three deviations over the score if that is more."""
    size = F.when(score == 0, 1e-9).otherwise(F.abs(score))
    return F.greatest(0.01 * size, F.when(F.coalesce(std, F.lit(0.0)) > 0, 3.0 * std / size).otherwise(0.0))


def check_i1(scored: DataFrame) -> DataFrame:
    """Scores against re-extracted ones: (node_id, check_status, delta, tolerance); a missing one skips."""
    tol, delta = i1_tolerance(F.col("score"), F.col("score_std")), F.abs(F.col("reextracted") - F.col("score"))
    status = F.when(F.col("score").isNull() | F.col("reextracted").isNull(), "skipped").when(delta <= tol, "passed").otherwise("failed")
    return scored.select("node_id", status.alias("check_status"), delta.alias("delta"), tol.alias("tolerance"))


def check_i2(experiments: DataFrame, has_spec: bool = True) -> DataFrame:
    """Verdicts against a task specification: compliant passes, anything else fails, none without a specification."""
    status = F.when(F.col("verdict") == "compliant", "passed").otherwise("failed") if has_spec else F.lit("skipped")
    return experiments.select("node_id", status.alias("check_status"))


def check_i3(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Raw citations against a catalogue (key): (node_id, check_status); no citation skips.  Null keys are spread by the join itself."""
    named = citations.where(F.col("raw_citation").isNotNull())
    hit = named.join(catalogue.select(F.col("key").alias("cite_key"), F.lit(True).alias("hit")).dropDuplicates(["cite_key"]), "cite_key", "left")
    out = hit.select("node_id", F.when(F.col("hit"), "passed").otherwise("failed").alias("check_status"))
    return out.unionByName(citations.where(F.col("raw_citation").isNull()).select("node_id", F.lit("skipped").alias("check_status")))


def children(edges: DataFrame, atoms: DataFrame, k: int = 3, chars: int = 3000) -> DataFrame:
    """(node_id, n_children, code): the first ``k`` component children and their bodies (else contexts), joined and cut to ``chars``."""
    comp = atoms.where(F.col("type") == "component").select(F.col("node_id").alias("tgt"), F.coalesce("code_body", "context").alias("body"))
    down = edges.where(F.col("relation") == "decomposes_into").select("src", "tgt").distinct().join(comp, "tgt")
    first = Window.partitionBy("src").orderBy("tgt")
    top = down.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    joined = top.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sort_array(F.collect_list(F.struct("n", "body"))).alias("b"))  # k rows at most
    return joined.select("node_id", "n_children", F.substring(F.array_join(F.transform("b", lambda x: x["body"]), "\n"), 1, chars).alias("code"))


def check_i4(subjects: DataFrame) -> DataFrame:
    """Verdicts on alignment with code children: aligned passes, partially_aligned fails softly, none without children."""
    status = F.when(F.coalesce("n_children", F.lit(0)) == 0, "skipped").when(F.col("verdict") == "aligned", "passed").otherwise("failed")
    return subjects.select("node_id", status.alias("check_status"), ((status == "failed") & (F.col("verdict") == "partially_aligned")).alias("soft"))


def outcome(checks: DataFrame) -> DataFrame:
    """(node_id, new_status): from all checks of an atom (node_id, check, check_status, soft).

    Any soft failure (I1, or partial alignment) gives low_confidence, else any
    failure low_reliability, else verified, also when everything was skipped.
    """
    failed = F.col("check_status") == "failed"
    soft = failed & ((F.col("check") == "I1") | F.coalesce("soft", F.lit(False)))
    agg = checks.groupBy("node_id").agg(F.max(failed).alias("f"), F.max(soft).alias("s"))
    return agg.select("node_id", F.when(F.col("s"), "low_confidence").when(F.col("f"), "low_reliability").otherwise("verified").alias("new_status"))


def report(dispatched: DataFrame, outcomes: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: audited, passed, failed, skipped, failures per check, and the share of numerical atoms verified.

    ``cpr_strict`` leaves out atoms whose only check was skipped.
    """
    d = dispatched.join(outcomes, "node_id", "left").join(checks.groupBy("node_id").agg(F.min(F.col("check_status") == "skipped").alias("idle")), "node_id", "left")
    audited, num = F.col("action") == "audited", (F.col("action") == "audited") & (F.col("type") == "numerical")
    ok = F.col("new_status") == "verified"
    main = d.agg(
        F.count_if(audited).alias("n_audited"), F.count_if(audited & ok).alias("n_passed"), F.count_if(audited & ~ok).alias("n_failed"), F.count_if(~audited).alias("n_skipped"),
        F.round(F.coalesce(F.try_divide(F.count_if(num & ok), F.count_if(num)), F.lit(0.0)), 6).alias("cpr"),
        F.round(F.coalesce(F.try_divide(F.count_if(num & ok & ~F.col("idle")), F.count_if(num & ~F.col("idle"))), F.lit(0.0)), 6).alias("cpr_strict"),
    )
    fails = checks.agg(*[F.count_if((F.col("check") == c) & (F.col("check_status") == "failed")).alias(f"failed_{c.lower()}") for c in ("I1", "I2", "I3", "I4")])
    return main.join(F.broadcast(fails))  # one row each


# -- the audit of a base -------------------------------------------------------

#: Characters of an atom's text, and of its code, that a prompt takes.
CONTEXT_CHARS, CODE_CHARS = 1_000, 2_000


def checks(atoms: DataFrame, edges: DataFrame, *, model: providers.Model | None = None, spec: dict | None = None, catalogue: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(node_id, check, check_status, soft, resolved): the check of every atom that has one.

    ``atoms`` are those to be audited, with promoted provenance.  Scores are read
    again by the model; experiments are held against ``spec``, and skipped without
    one; citations against ``catalogue`` (key, resolved: a record as JSON); methods
    and solutions against the code of their components.  Verdicts are votes of ``k``
    replies; where the model fails altogether, a check is skipped.
    """
    spark = atoms.sparkSession
    quiet = [F.lit(False).alias("soft"), F.lit(None).cast("string").alias("resolved")]
    num = atoms.where("type = 'numerical'")
    asked = num.where("score is not null").select("node_id", F.substring("context", 1, CONTEXT_CHARS).alias("prompt"))
    again = providers.verdicts(asked, "node_id", "score", "score", model).select("node_id", F.col("score").try_cast("double").alias("reextracted"))
    i1 = check_i1(num.join(again, "node_id", "left")).select("node_id", F.lit("I1").alias("check"), "check_status", *quiet)

    exp = atoms.where("type = 'experiment'")
    if spec is None:
        i2 = check_i2(exp, has_spec=False)
    else:
        asked = exp.select("node_id", F.concat(F.lit(json.dumps(spec) + "\n"), F.substring(F.coalesce("code_body", "context"), 1, CODE_CHARS)).alias("prompt"))
        said = exp.select("node_id").join(providers.verdicts(asked, "node_id", "spec", "verdict", model, k), "node_id", "left")
        i2 = check_i2(said.where("verdict is not null")).unionByName(said.where("verdict is null").select("node_id", F.lit("skipped").alias("check_status")))
    i2 = i2.select("node_id", F.lit("I2").alias("check"), "check_status", *quiet)

    cites = atoms.where("type = 'citation'").withColumn("cite_key", F.col("raw_citation"))
    known = spark.createDataFrame([], "key string, resolved string") if catalogue is None else catalogue.select("key", "resolved").dropDuplicates(["key"])
    i3 = check_i3(cites, known).select("node_id", F.lit("I3").alias("check"), "check_status", F.lit(False).alias("soft"))
    hit = cites.join(known.withColumnRenamed("key", "cite_key"), "cite_key").select("node_id", "resolved")
    i3 = i3.join(hit, "node_id", "left")

    subjects = atoms.where("type in ('method', 'solution')").select("node_id", "context")
    kids = subjects.join(children(edges, atoms), "node_id", "left")
    asked = kids.where("n_children > 0").select("node_id", F.concat(F.substring("context", 1, CONTEXT_CHARS), F.lit("\n"), "code").alias("prompt"))
    said = kids.join(providers.verdicts(asked, "node_id", "align", "verdict", model, k), "node_id", "left")
    said = said.withColumn("n_children", F.when(F.col("verdict").isNull(), 0).otherwise(F.col("n_children")))
    i4 = check_i4(said).select("node_id", F.lit("I4").alias("check"), "check_status", "soft", F.lit(None).cast("string").alias("resolved"))
    return i1.unionByName(i2).unionByName(i3).unionByName(i4)


def verify(atoms: DataFrame, edges: DataFrame, **named) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms after the audit, the report (one row) and the verdicts per atom (node_id, type, status, checks, reason).

    Only active atoms are audited.  Each gets its new status: verified,
    low_confidence, low_reliability, or skipped if its type has no check.  A citation
    that was found gets the record into its provenance (``resolved``).  ``named`` as
    in ``checks``.
    """
    mine = cut(with_provenance(audited(atoms)))
    d = dispatch(mine)
    done = cut(checks(mine, edges, **named))
    results = cut(outcome(done))
    new = d.select("node_id", "action").join(results, "node_id", "left").select("node_id", F.when(F.col("action") == "skipped", "skipped").otherwise(F.coalesce("new_status", F.lit("verified"))).alias("__status"))
    found = done.where("resolved is not null").groupBy("node_id").agg(F.max("resolved").alias("__resolved"))
    out = atoms.join(new, "node_id", "left").join(found, "node_id", "left")
    patch = F.concat(F.lit('{"resolved":'), "__resolved", F.lit("}"))
    prov = F.when(F.col("__resolved").isNotNull(), merged(F.col("provenance"), patch)).otherwise(F.col("provenance"))
    cols = {"status": F.coalesce("__status", "status").alias("status"), "provenance": prov.alias("provenance")}
    after = out.select(*[cols.get(c, F.col(c)) for c in atoms.columns])
    named_checks = done.groupBy("node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check", "check_status")))).alias("checks"))  # one per kind of check
    per = d.join(new, "node_id").join(named_checks, "node_id", "left")
    reason = F.when(F.col("action") == "skipped", "no check for this type")
    per = per.select("node_id", "type", F.col("__status").alias("status"), F.coalesce("checks", F.expr("cast(map() as map<string,string>)")).alias("checks"), reason.alias("reason"))
    return after, report(d, results, done), per
