"""Tables, manifests, reports and submission files."""

from __future__ import annotations

import json
import os
import stat
import zipfile
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Submission layout and safety limits.
MEMBER = "submission.json"
ZIP_TIME = (1980, 1, 1, 0, 0, 0)
MAX_JSON, MAX_ZIP, MAX_RATIO = 128 << 20, 256 << 20, 200.0


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parents and chunks as two partitions of one table, in one pass (SNK-01, SNK-02)."""
    records.write.mode(mode).partitionBy("record").parquet(path)


def write_by_fold(rows: DataFrame, path: str, fold: str = "fold", mode: str = "errorifexists") -> None:
    """One folder of JSON lines per fold (SNK-11).

    Rows are spread by fold and a hash, so a large fold is written by many tasks.
    """
    spread = rows.repartition(F.col(fold), F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    spread.write.mode(mode).partitionBy(fold).json(path)


def write_pending(frame: DataFrame, path: str, key: str = "qid") -> DataFrame:
    """Append only questions that are not stored yet, then read back (SNK-10)."""
    spark = frame.sparkSession
    todo = frame
    if table_exists(spark, path):
        todo = frame.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def canonical_json(payload: object) -> bytes:
    return (json.dumps(payload, ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True) + "\n").encode()


def write_atomic(path: str | Path, data: bytes) -> Path:
    """Stage next to the target, then replace it (SNK-04)."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    staged.write_bytes(data)
    os.replace(staged, target)
    return target


def write_bundle(files: Mapping[str | Path, bytes]) -> list[Path]:
    """Several report files that appear together or not at all (SNK-05)."""
    previous = {Path(p): Path(p).read_bytes() if Path(p).exists() else None for p in files}
    written: list[Path] = []
    try:
        for path, data in files.items():
            written.append(write_atomic(path, data))
    except OSError:
        for path in written:
            if previous[path] is None:
                path.unlink(missing_ok=True)
            else:
                write_atomic(path, previous[path])
        raise
    return written


def write_manifest(path: str | Path, **fields: object) -> Path:
    """Run manifest with its creation time, written after the tables (SNK-04, DT-01)."""
    stamp = datetime.now(timezone.utc).isoformat()
    return write_atomic(path, json.dumps({"created_at_utc": stamp, **fields}, ensure_ascii=False, indent=2, sort_keys=True).encode() + b"\n")


def markdown_table(rows: DataFrame, title: str, limit: int = 200) -> str:
    """Markdown rendering of a small report (SNK-06); a longer one is refused, not cut."""
    body = rows.take(limit + 1)
    if len(body) > limit:
        raise ValueError(f"a report of more than {limit} rows; aggregate it first")
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in row) + " |\n" for row in body)


# -------------------------------------------------------------- submissions


def submission_rows(answers: DataFrame, column: str) -> DataFrame:
    """``qid`` and its JSON object in id order; sorted by Spark."""
    return answers.select("qid", F.to_json(F.struct(F.col(column).alias("answer"))).alias("entry")).orderBy("qid")


def write_submission_parts(answers: DataFrame, path: str, column: str = "answer", mode: str = "errorifexists") -> None:
    """The same entries as sorted JSON-line part files, written by Spark."""
    submission_rows(answers, column).write.mode(mode).json(path)


def package(answers: DataFrame, path: str | Path, column: str = "answer") -> Path:
    """Deterministic submission JSON or ZIP (SNK-07).

    A submission is one file by its contract; rows are streamed to it in order,
    one partition at a time. ``write_submission_parts`` writes any size.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.tmp")

    def pieces() -> Iterable[bytes]:
        first = True
        for row in submission_rows(answers, column).toLocalIterator():
            text = ("{" if first else ",") + json.dumps(str(row["qid"]), ensure_ascii=False) + ":" + row["entry"]
            first = False
            yield text.encode()
        yield b"{}\n" if first else b"}\n"

    if target.suffix.lower() == ".zip":
        info = zipfile.ZipInfo(MEMBER, ZIP_TIME)
        info.compress_type = zipfile.ZIP_DEFLATED
        info.external_attr = 0o644 << 16
        with zipfile.ZipFile(staged, "w") as archive, archive.open(info, "w") as member:
            for piece in pieces():
                member.write(piece)
    elif target.suffix.lower() == ".json":
        with staged.open("wb") as stream:
            for piece in pieces():
                stream.write(piece)
    else:
        raise ValueError("a submission is .json or .zip")
    os.replace(staged, target)
    return target


def _strict(text: str) -> object:
    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("repeated JSON key")
        return found

    def refuse(value: str) -> object:
        raise ValueError(f"non-finite number {value}")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def load_submission(path: str | Path, expected: Iterable[str] | None = None, empty: str = "allow") -> dict[str, object]:
    """Read and validate a submission as an outside reader would (SRC-22, SNK-08)."""
    source = Path(path)
    if source.is_symlink() or not stat.S_ISREG(source.stat().st_mode):
        raise ValueError("a submission must be a regular file")
    if source.suffix.lower() == ".zip":
        if source.stat().st_size > MAX_ZIP:
            raise ValueError("archive too large")
        with zipfile.ZipFile(source) as archive:
            members = archive.infolist()
            if len(members) != 1 or members[0].filename != MEMBER:
                raise ValueError(f"the archive must hold {MEMBER} and nothing else")
            member = members[0]
            if member.flag_bits & 1 or stat.S_ISLNK(member.external_attr >> 16):
                raise ValueError("encrypted or linked members are refused")
            if member.file_size > MAX_JSON or (member.file_size and member.file_size / max(1, member.compress_size) > MAX_RATIO):
                raise ValueError("member expands beyond the limit")
            raw = archive.read(member)
    else:
        if source.stat().st_size > MAX_JSON:
            raise ValueError("file too large")
        raw = source.read_bytes()
    payload = _strict(raw.decode("utf-8"))
    if not isinstance(payload, dict) or not payload:
        raise ValueError("a submission maps question ids to answers")
    for qid, item in payload.items():
        if qid != qid.strip() or not qid or not isinstance(item, dict) or set(item) != {"answer"}:
            raise ValueError(f"invalid entry {qid!r}")
        answer = item["answer"]
        if isinstance(answer, list):
            if not 1 <= len(answer) <= 5 or len(set(answer)) != len(answer) or not all(isinstance(a, str) for a in answer):
                raise ValueError(f"{qid!r} needs one to five different documents")
        elif not isinstance(answer, str):
            raise ValueError(f"{qid!r} has no text answer")
        elif not answer.strip() and empty == "error":
            raise ValueError(f"{qid!r} has an empty answer")
    if expected is not None and set(payload) != set(expected):
        raise ValueError("submission does not cover the expected questions")
    return {qid: item["answer"] for qid, item in payload.items()}


# -------------------------------------------------------------- vector table


def write_vectors(vectors: DataFrame, path: str, distance: str = "cosine") -> None:
    """Vector table with checked, normalised vectors (SNK-09, SRC-21)."""
    from lexatlas.operators.vectors import unit

    if distance not in ("cosine", "dot"):
        raise ValueError("distance is cosine or dot")
    ready = vectors.withColumn("v", unit(F.col("v")) if distance == "cosine" else F.col("v").cast("array<float>"))
    ready.write.mode("overwrite").parquet(path)


def commit_upsert(existing_path: str, incoming: DataFrame, target_path: str, key: str = "vec_id", sequence: str = "seq") -> DataFrame:
    """Merged table under a new path; readers switch when it is complete (SNK-09)."""
    from lexatlas.operators.vectors import upsert

    spark = incoming.sparkSession
    upsert(spark.read.parquet(existing_path), incoming, key, sequence).write.mode("errorifexists").parquet(target_path)
    return spark.read.parquet(target_path)


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Vector table whose ids are unique and vectors valid (SRC-21)."""
    from lexatlas.operators.vectors import is_valid

    table = spark.read.parquet(path)
    problems = table.agg(
        (F.count(F.lit(1)) - F.count_distinct("vec_id")).alias("repeated"), F.count_if(~is_valid(F.col("v"), dimension)).alias("invalid")
    ).first()
    if problems["repeated"] or problems["invalid"]:
        raise ValueError(f"vector table is damaged: {problems.asDict()}")
    return table
