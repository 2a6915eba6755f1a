"""Dataset packs (manifest.yaml beside cases.jsonl), adapters of public file formats and inputs of judging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigrade.sources import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON Lines file; a line that doesn't fit the schema is an error, blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(path: str) -> dict:
    """manifest.yaml of a pack. With schema_version unknown or missing keys are an error, without it they are tolerated."""
    import yaml

    manifest = yaml.safe_load((Path(path) / "manifest.yaml").read_text(encoding="utf-8"))
    if not isinstance(manifest, dict):
        raise ValueError("a manifest must be a mapping")
    plain = {"name", "version", "split", "license", "pii_scrubbed", "created_at", "slices"}
    versioned = {"schema_version", "tier", "source", "adapter", "task_metrics", "contamination_risk", "pii_scrub_procedure"}
    if missing := plain - manifest.keys():
        raise ValueError(f"manifest lacks {sorted(missing)}")
    if "schema_version" in manifest:
        if missing := versioned - manifest.keys():
            raise ValueError(f"manifest lacks {sorted(missing)}")
        if extra := manifest.keys() - plain - versioned - {"content_sha256"}:
            raise ValueError(f"manifest has unknown keys {sorted(extra)}")
    return manifest


def content_sha256(spark: SparkSession, path: str) -> str:
    """Digest of a pack's content: its stripped lines but the blank ones, joined by line breaks, in file order.

    The lines of one file are read in order by one task; nothing but its running digest leaves it.
    """

    def digest(frames: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        h, first = hashlib.sha256(), True
        for f in frames:
            for line in f["value"]:
                line = line.strip()
                if line:
                    h.update(line.encode() if first else b"\n" + line.encode())
                    first = False
        yield pd.DataFrame({"sha256": [h.hexdigest()]})

    lines = spark.read.option("wholetext", "false").text(path).coalesce(1)
    return lines.mapInPandas(digest, "sha256 string").first()[0]


def read_pack(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(manifest, cases) of a pack directory."""
    return read_manifest(path), read_jsonl(spark, f"{path}/cases.jsonl", schemas.CASE)


def _case(task: str, case_id: F.Column, inputs: dict, **columns: F.Column) -> list[F.Column]:
    """The columns of schemas.CASE with those given and the rest empty."""
    have = {"id": case_id.cast("string"), "task_type": F.lit(task), "inputs": F.create_map(*(x for k, v in inputs.items() for x in (F.lit(k), v.cast("string")))), "weight": F.lit(1.0)} | columns
    return [have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CASE]


def squad(spark: SparkSession, path: str) -> DataFrame:
    """Nested articles, paragraphs and questions; questions without answer are left out, the first answer is the reference."""
    answers = "array<struct<text:string,answer_start:int>>"
    raw = spark.read.schema(f"data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:{answers}>>>>>>").option("multiLine", "true").json(path)
    p = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = p.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).where(F.size("q.answers") > 0)
    return q.select(*_case("qa_short", F.col("q.id"), {"question": F.col("q.question"), "context": F.col("context")}, reference_answer=F.col("q.answers")[0]["text"], references=F.col("q.answers.text")))


# Names of the topic labels 1 to 4.
NEWS_LABELS = ("World", "Sports", "Business", "Sci/Tech")


def ag_news(spark: SparkSession, path: str) -> DataFrame:
    """Three-column CSV of label, title and text; the id is the row's number. Rows of one file are numbered by its only reader."""
    raw = spark.read.schema("label int, title string, body string, extra string").option("quote", '"').option("escape", '"').option("multiLine", "true").option("mode", "PERMISSIVE").csv(path).coalesce(1)
    n = F.monotonically_increasing_id()
    label = F.try_element_at(F.array(*(F.lit(x) for x in NEWS_LABELS)), F.col("label"))
    checked = F.when(label.isNull() | F.col("extra").isNotNull() | F.col("body").isNull(), F.raise_error(F.lit("a row must have a label from 1 to 4 and three columns"))).otherwise(label)
    return raw.select(*_case("classification", F.concat(F.lit("ag-"), n), {"text": F.concat_ws(" ", "title", "body"), "labels": F.lit(", ".join(NEWS_LABELS))}, expected_label=checked))


def pubmedqa(spark: SparkSession, path: str) -> DataFrame:
    """One object keyed by id; contexts are a list or a single text."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "v"))
    f = F.from_json("v", "struct<QUESTION:string,CONTEXTS:array<string>,CONTEXT:string,final_decision:string>")
    r = raw.select("id", f.alias("r"))
    return r.select(*_case("classification", F.col("id"), {"question": F.col("r.QUESTION"), "context": F.coalesce(F.array_join("r.CONTEXTS", "\n"), F.col("r.CONTEXT")), "labels": F.lit("yes, no, maybe")}, expected_label=F.col("r.final_decision")))


def phrasebank(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sentence@label, split at the last @."""
    raw = spark.read.text(path).where(F.btrim("value") != "")
    label = F.btrim(F.substring_index("value", "@", -1))
    sentence = F.btrim(F.regexp_replace("value", "@[^@]*$", ""))
    return raw.select(*_case("classification", F.concat(F.lit("pb-"), F.left(F.sha2("value", 256), F.lit(16))), {"text": sentence, "labels": F.lit("positive, negative, neutral")}, expected_label=label))


def finqa(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array; the texts before and after the table are joined by line breaks."""
    raw = spark.read.schema("id string, pre_text array<string>, post_text array<string>, qa struct<question:string,answer:string>").option("multiLine", "true").json(path)
    text = F.array_join(F.concat(F.coalesce("pre_text", F.array().cast("array<string>")), F.coalesce("post_text", F.array().cast("array<string>"))), "\n")
    return raw.select(*_case("qa_short", F.col("id"), {"question": F.col("qa.question"), "context": text}, reference_answer=F.col("qa.answer")))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Lines with document or article, and summary or highlights."""
    raw = read_jsonl(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in ("id", "document", "article", "summary", "highlights")]))
    return raw.select(*_case("summarization", F.col("id"), {"document": F.coalesce("document", "article")}, reference_answer=F.coalesce("summary", "highlights")))


def passthrough(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.CASE)


@dataclass(frozen=True)
class Adapter:
    name: str
    read: Callable[[SparkSession, str], DataFrame]
    task: str
    metrics: tuple[str, ...]


ADAPTERS = {
    a.name: a
    for a in (
        Adapter("squad", squad, "qa_short", ("squad_f1", "exact_match")),
        Adapter("ag_news", ag_news, "classification", ("classification",)),
        Adapter("pubmedqa", pubmedqa, "classification", ("classification",)),
        Adapter("phrasebank", phrasebank, "classification", ("classification",)),
        Adapter("finqa", finqa, "qa_short", ("numeric_assertion",)),
        Adapter("summaries", summaries, "summarization", ("rouge_l", "chrf_pp")),
        Adapter("synthetic", passthrough, "qa_short", ("exact_match",)),
        Adapter("scifact_prejoined", passthrough, "retrieval", ("retrieval_ndcg_10",)),
        Adapter("docred_prejoined", passthrough, "extraction", ("json_validity", "json_field_f1")),
    )
}


def within_bounds(cases: DataFrame, inputs: int = 2000, references: int = 500) -> DataFrame:
    """Cases whose inputs and references are short enough to be kept."""
    ok = F.forall(F.map_values("inputs"), lambda x: F.coalesce(F.length(x), F.lit(0)) <= inputs)
    refs = F.concat(F.array("reference_answer", "expected_label"), F.coalesce("references", F.array().cast("array<string>")))
    return cases.where(F.coalesce(ok, F.lit(True)) & F.forall(refs, lambda x: F.coalesce(F.length(x), F.lit(0)) <= references))


def register(spark: SparkSession) -> None:
    """spark.read.format("verdigrade_pack").load(directory): cases of all packs under a directory, one task a pack."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Packs(DataSource):
        @classmethod
        def name(cls) -> str:
            return "verdigrade_pack"

        def schema(self) -> str:
            return "pack string, id string, task_type string, inputs string, reference_answer string, slices string"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options["path"])

    class Reader(DataSourceReader):
        def __init__(self, root: str) -> None:
            self.root = root

        def partitions(self) -> list:
            return [InputPartition(str(p.parent)) for p in sorted(Path(self.root).rglob("cases.jsonl"))]

        def read(self, partition) -> Iterator[tuple]:
            import json

            with open(Path(partition.value) / "cases.jsonl", encoding="utf-8") as f:
                for line in f:
                    if line.strip():
                        c = json.loads(line)
                        yield Path(partition.value).name, c.get("id"), c.get("task_type"), json.dumps(c.get("inputs")), c.get("reference_answer"), json.dumps(c.get("slices"))

    spark.dataSource.register(Packs)
