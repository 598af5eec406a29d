"""The whole pipeline as one lazy plan, and a command line for it.

    python -m claimweave.plans.pipeline --csv people.csv --resume cv.docx --config view.json
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import AS_OF
from ..functions.normalize import failure_warnings, normalize_claims
from ..operators import canonical as C
from ..operators.projection import ProjectionConfig, load_config, missing, project, row_json
from ..operators.taxonomy import from_dict, load
from ..operators.validate import validate
from ..sources import files as S
from .extract import document_claims


@dataclass
class Result:
    """Lazy tables of a run, and the log of its steps.

    ``output`` has the projected and validated rows; ``failed`` (entity_id,
    error, profile) those that the config could not be applied to, whole;
    ``envelopes`` (entity_id, json) both as one JSON object for each entity.
    """

    sources: DataFrame
    claims: DataFrame
    profiles: DataFrame
    output: DataFrame
    failed: DataFrame
    envelopes: DataFrame
    warnings: DataFrame
    log: list[dict]

    def counted(self) -> list[dict]:
        """The log with the number of rows that each step has made; this runs the plan."""
        tables = {"input": self.sources, "normalize": self.claims, "arbitrate": self.profiles, "project": self.output}
        return [entry | ({"rows": tables[entry["step"]].count()} if entry["step"] in tables else {}) for entry in self.log]


def run(
    spark: SparkSession, csv: list[str] = (), documents: list[str] = (), config: ProjectionConfig | None = None, taxonomy: dict | DataFrame | None = None, entity: str = "email",
    as_of: str = AS_OF, timestamp: str | None = None, pdf_text=None, ocr=None, pdf_head=None,
) -> Result:
    """Fuse structured files and documents into one validated profile for each entity.

    ``entity`` is ``email`` (each person's own profile) or ``run`` (all sources
    of the run describe one person).  Missing and unreadable files become
    warnings.  An entity that lacks a required value fails by itself and keeps
    its whole profile; a projection that cannot be compiled gives whole profiles
    for all.  ``pdf_text``, ``ocr`` and ``pdf_head`` (the text of the first three
    pages, by which scans are known) are readers for PDF, from bytes to text.
    """
    paths = [*csv, *documents]
    if not paths:
        raise ValueError("Invalid input: neither a structured file nor a document was given")
    config = config or ProjectionConfig()
    log = [{"step": "input", "details": f"{len(csv)} structured, {len(documents)} documents"}]
    found = S.read_files(spark, paths)
    detected = S.detect(found, pdf_head(F.col("content")) if pdf_head else None, content=True)
    sources = detected.drop("content").unionByName(S.missing_files(S.absent(spark, paths)))
    one = F.lit("run") if entity == "run" else None
    table = taxonomy if isinstance(taxonomy, DataFrame) else from_dict(spark, taxonomy or {})
    terms = taxonomy if isinstance(taxonomy, dict) else None
    records = S.csv_records(detected.where("readable and detected_type = 'csv'").select(F.col("file_path").alias("path"), "content"))
    texts = S.document_text(detected, pdf_text, ocr)
    claims = S.csv_claims(records, one).unionByName(document_claims(texts, table, one))
    log.append({"step": "extract", "details": "claims of structured cells and documents"})
    claims = normalize_claims(claims, table)
    log.append({"step": "normalize", "details": "one normalizer for each field"})
    profiles = C.canonical(claims, timestamp or f"{as_of}-20T00:00:00Z", as_of)
    log.append({"step": "arbitrate", "details": "one strategy for each field, 13 provenance records"})
    why = F.lit(None).cast("string")
    try:
        why = missing(profiles, config)
        good = profiles.withColumn("_why", why).where("_why is null").drop("_why")
        checked = validate(project(good, config, terms, strict=False), config)
        log.append({"step": "project", "details": f"{len(config.fields) or 'all'} fields"})
    except Exception as e:  # noqa: BLE001  a config that does not compile must not lose the profiles
        log.append({"step": "project", "details": f"failed, whole profiles instead: {e}"})
        why = F.lit(None).cast("string")
        config = ProjectionConfig()
        checked = validate(project(profiles, config, terms))
    whole = [c for c in profiles.columns if c != "entity_id"]
    failed = profiles.withColumn("error", why).where("error is not null").select("entity_id", "error", row_json(whole).alias("profile"))
    verdict = ("validation_errors", "validation_warnings", "valid")
    body = row_json([c for c in checked.columns if c not in ("entity_id", *verdict)], config.on_missing == "omit")
    said = F.to_json(F.struct(*verdict), {"ignoreNullFields": "false"})
    envelopes = checked.select("entity_id", F.concat(F.lit('{"success":true,"output":'), body, F.lit(',"validation":'), said, F.lit("}")).alias("json")).unionByName(
        failed.select("entity_id", F.concat(F.lit('{"success":false,"error":'), F.to_json(F.array("error")), F.lit(',"profile":'), "profile", F.lit("}")).alias("json"))
    )
    said = failure_warnings(claims).select("entity_id", F.explode("warnings").alias("warning"))
    for rows, name in ((sources.withColumn("source", F.col("file_name")), "source"), (records, "source"), (texts, "source")):
        said = said.unionByName(rows.where("warning is not null").select(F.lit(None).cast("string").alias("entity_id"), F.concat(name, F.lit(": "), "warning").alias("warning")))
    return Result(sources, claims, profiles, checked, failed, envelopes, said, log)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--csv", action="append", default=[])
    p.add_argument("--resume", action="append", default=[])
    p.add_argument("--config")
    p.add_argument("--taxonomy")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("claimweave").getOrCreate()
    result = run(spark, a.csv, a.resume, load_config(a.config), load(spark, [a.taxonomy] if a.taxonomy else []))
    for row in result.envelopes.toLocalIterator():
        print(row.json)


if __name__ == "__main__":
    main()
