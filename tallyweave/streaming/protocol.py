"""The line protocol: relation paths up to ``Done``, then queries, with ``F`` at the end of each batch.

A batch's queries don't depend on each other: they run as concurrent Spark jobs, and answers are
written in the order of the queries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.plans.planner import Planner
from tallyweave.sources.catalog import Catalog

END_OF_RELATIONS, END_OF_BATCH, FAILED = "Done", "F", "ERROR"


def read_relations(lines: Iterator[str]) -> list[str]:
    """Paths up to the line that ends the list (or the end of input); blank lines are skipped."""
    out = []
    for line in lines:
        line = line.strip()
        if line == END_OF_RELATIONS:
            break
        if line:
            out.append(line)
    return out


def read_batches(lines: Iterable[str]) -> Iterator[list[str]]:
    """Lists of query texts, one for each batch; blank lines are skipped, and the end of input ends the last batch."""
    batch: list[str] = []
    for line in lines:
        line = line.strip("\r\n")
        if line.startswith(END_OF_BATCH):
            yield batch
            batch = []
        elif line.strip():
            batch.append(line)
    if batch:
        yield batch


def batch_frame(planner: Planner, queries: Iterable[str]) -> DataFrame:
    """(query_no, answer) for a batch, as one plan: scans that queries share are reused by Spark."""
    parts = [planner.answer(q).select(F.lit(k).cast("bigint").alias("query_no"), "answer") for k, q in enumerate(queries)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


class Engine:
    """Answers queries, those of a batch concurrently in fair pools."""

    def __init__(self, planner: Planner, threads: int = 8):
        self.planner, self.threads = planner, threads
        self.spark = planner.catalog.spark

    def answer(self, query: str, pool: str = "default") -> str:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return self.planner.answer(query).first()["answer"]

    def answers(self, queries: list[str]) -> Iterator[str | Exception]:
        """In the order of the queries each answer, as soon as it and those before it are done, or what went wrong."""
        with ThreadPoolExecutor(max(1, min(self.threads, len(queries)))) as pool:
            running = [pool.submit(self.answer, q, f"query{k % self.threads}") for k, q in enumerate(queries)]
            for one in running:
                yield one.exception() or one.result()

    def answer_batch(self, queries: list[str]) -> list[str]:
        """Answers in the order of the queries; one that fails raises after those before it are done."""
        out = []
        for answer in self.answers(queries):
            if isinstance(answer, Exception):
                raise answer
            out.append(answer)
        return out


def serve(spark: SparkSession, source: TextIO = sys.stdin, sink: TextIO = sys.stdout, *, unsigned: bool = False, parquet_dir: str | None = None, threads: int = 8) -> None:
    """Run the protocol from ``source`` to ``sink``. Paths ending in .parquet are Parquet, others binary relations (converted under
    ``parquet_dir`` if given). Statistics are gathered before the first query. Answers are written as they finish; a query that fails has the line ERROR
    in its place, and the reason is raised when its batch is written."""
    lines = iter(source.readline, "")
    catalog = Catalog(spark)
    for k, path in enumerate(read_relations(lines)):
        if path.rstrip("/").endswith(".parquet"):
            catalog.add_parquet(path, unsigned)
        else:
            catalog.add_binary(path, unsigned, parquet_dir and f"{parquet_dir.rstrip('/')}/r{k}.parquet")
    catalog.gather()
    engine = Engine(Planner(catalog), threads)
    for batch in read_batches(lines):
        failed = None
        for answer in engine.answers(batch):
            failed = failed or (answer if isinstance(answer, Exception) else None)
            sink.write((FAILED if isinstance(answer, Exception) else answer) + "\n")
            sink.flush()
        if failed:
            raise failed


def main() -> None:
    """Console entry: the protocol on standard input and output."""
    import argparse

    options = argparse.ArgumentParser(description=main.__doc__)
    options.add_argument("--unsigned", action="store_true", help="values may be 2^63 and over")
    options.add_argument("--parquet-dir", help="convert binary relations here")
    options.add_argument("--threads", type=int, default=8)
    given = options.parse_args()
    spark = SparkSession.builder.config("spark.scheduler.mode", "FAIR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    serve(spark, unsigned=given.unsigned, parquet_dir=given.parquet_dir, threads=given.threads)


if __name__ == "__main__":
    main()
