"""Companies by domain: attributes from an outside service, a chain of such steps, lookups that enrich what is missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import lifecycle

ATTRIBUTES = ("name", "size", "industry", "location", "linkedin", "details")
# Answers that leave a company as it is (unknown to the service, too many requests); any other but 200 is a failure.
HARMLESS = (404, 429)

_PAYLOAD = (
    "data struct<name:string,location:string,domain:string,description:string,foundedYear:string,companyType:string,metrics:struct<employees:string>,tags:array<string>,tech:array<string>,"
    "linkedin:struct<handle:string>,geo:struct<country:string>>"
)


def attributes(answers: DataFrame) -> DataFrame:
    """domain, failed and ATTRIBUTES (null where the answer says nothing; details as JSON) of a service's answers (domain, status, body)."""
    d = F.from_json("body", _PAYLOAD)["data"]
    good = (F.col("status") == 200) & d.isNotNull()
    details = F.to_json(F.struct(d["domain"].alias("domain"), d["description"].alias("description"), d["foundedYear"].alias("founded"), d["companyType"].alias("company_type"), F.coalesce(d["tech"], F.array().cast("array<string>")).alias("tech_stack"), d["geo"]["country"].alias("country")))
    employees = F.when(~F.coalesce(d["metrics"]["employees"].isin("", "0"), F.lit(False)), d["metrics"]["employees"])
    handle = T.filled(d["linkedin"]["handle"])
    found = {"name": d["name"], "size": employees, "industry": T.filled(F.array_join(d["tags"], ", ")), "location": d["location"], "linkedin": F.concat(F.lit("https://linkedin.com/"), handle), "details": details}
    return answers.select("domain", (~good & ~F.coalesce(F.col("status").isin(*HARMLESS), F.lit(False))).alias("failed"), *[F.when(good, col).alias(name) for name, col in found.items()])


@dataclass(frozen=True)
class Step:
    """One enricher: what it found, (domain, failed, ATTRIBUTES), the steps that must come before it, and whether its failure matters."""

    name: str
    found: DataFrame
    requires: tuple[str, ...] = ()
    optional: bool = True


def enriched(companies: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Companies (domain, ATTRIBUTES, ...) after all steps in their order.

    What a step found replaces what was there, field by field.  A company of which an optional step failed
    goes on as it was; one of which a required step failed keeps what it has and takes part in no further step.
    """
    done: set[str] = set()
    for step in steps:
        if missing := [r for r in step.requires if r not in done]:
            raise ValueError(f"{step.name} needs {', '.join(missing)} before it")
        done.add(step.name)
    rows = companies.withColumn("_stopped", F.lit(False))
    for step in steps:
        found = step.found.dropDuplicates(["domain"]).select(F.col("domain").alias("_domain"), F.coalesce("failed", F.lit(False)).alias("_failed"), *[F.col(a).alias(f"_{a}") for a in ATTRIBUTES])
        rows = rows.join(found, F.col("domain") == F.col("_domain"), "left")
        taken = ~F.col("_stopped") & ~F.coalesce("_failed", F.lit(True))
        rows = rows.withColumns({a: F.when(taken & F.col(f"_{a}").isNotNull(), F.col(f"_{a}")).otherwise(F.col(a)) for a in ATTRIBUTES})
        if not step.optional:
            rows = rows.withColumn("_stopped", F.col("_stopped") | F.coalesce("_failed", F.lit(False)))
        rows = rows.select(*companies.columns, "_stopped")
    return rows.drop("_stopped")


def upserted(companies: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """The table of companies with new rows written over those of equal domains, enriched now."""
    return lifecycle.upserted(companies, new.withColumn("enriched_at", F.lit(as_of)).select(*companies.columns), ["domain"], [])


def looked_up(domains: DataFrame, companies: DataFrame, answers: DataFrame) -> DataFrame:
    """domain, outcome, ATTRIBUTES of asked domains: 'known' from the table, else 'enriched' from what the service found, else 'missing'."""
    asked = domains.select("domain").distinct()
    known = companies.select("domain", F.struct(*ATTRIBUTES).alias("known"))
    got = attributes(answers.join(asked, "domain", "left_semi").join(companies, "domain", "left_anti"))
    fresh = got.filter(~F.col("failed") & F.col("name").isNotNull()).dropDuplicates(["domain"]).select("domain", F.struct(*ATTRIBUTES).alias("fresh"))
    rows = asked.join(known, "domain", "left").join(fresh, "domain", "left")
    outcome = F.when(F.col("known").isNotNull(), "known").when(F.col("fresh").isNotNull(), "enriched").otherwise("missing")
    return rows.select("domain", outcome.alias("outcome"), *[F.coalesce(f"known.{a}", f"fresh.{a}").alias(a) for a in ATTRIBUTES])
