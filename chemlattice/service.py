"""Line protocol of the fingerprint service, and the command line.

A request ``FINGERPRINT <name> <smiles>`` is answered by ``FINGERPRINT <bits>``,
greatest bit first, or by a line that begins with ``ERROR``; ``EXIT`` or the end
of input ends the service. Other lines get no answer.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame

from chemlattice.functions.fingerprints import REGISTRY, available_fingerprints, fingerprint_words
from chemlattice.functions.graphs import graph_of

# Wording of the errors.
NO_NAME = "ERROR Fingerprint name not found"
NO_SMILES = "ERROR Could not determine smiles"
NOT_VALID = "ERROR Not a valid fingerprint name"
NOT_READ = "ERROR Could not read smiles"


def bit_string(words: list[int], n_bits: int) -> str:
    value = sum((w & (2**64 - 1)) << (64 * i) for i, w in enumerate(words))
    return format(value, f"0{n_bits}b")


def answer(line: str | None) -> str | None:
    """The answer to one request; None where there is none."""
    parts = (line or "").rstrip("\r\n").split(" ", 2)
    if parts[0] != "FINGERPRINT":
        return None
    if len(parts) < 2 or not parts[1]:
        return NO_NAME
    if len(parts) < 3:
        return NO_SMILES
    kind = REGISTRY.get(parts[1])
    if kind is None:
        return NOT_VALID
    g = graph_of(parts[2])
    if g is None:
        return NOT_READ
    return "FINGERPRINT " + bit_string(fingerprint_words(parts[1], g), kind.n_bits)


def serve(source: TextIO, sink: TextIO) -> None:
    for line in source:
        if line.strip() == "EXIT":
            return
        reply = answer(line)
        if reply is not None:
            print(reply, file=sink, flush=True)


def answers(requests: DataFrame, column: str = "value") -> DataFrame:
    """The same for a table or stream of request lines: ``value, answer``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([answer(x) for x in b.column(0).to_pylist()], pa.string())], names=["value", "answer"])

    return requests.select(requests[column].alias("value")).mapInArrow(each, "value string, answer string")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chemlattice")
    p.add_argument("store", nargs="?", help="folder of the store")
    p.add_argument("-create", action="store_true")
    p.add_argument("-insert", metavar="FILE")
    p.add_argument("-not-unique", action="store_true")
    p.add_argument("-add-fingerprint", metavar="NAME")
    p.add_argument("-list-fingerprints", action="store_true")
    p.add_argument("-info", action="store_true")
    p.add_argument("-query", metavar="SMILES")
    p.add_argument("-fingerprint", default="GraphPath", help="names with commas between them")
    p.add_argument("-Smin", type=float, default=0.8)
    p.add_argument("-search", choices=["exact", "screen", "similar", "full", "quick"], default="quick")
    p.add_argument("-algorithm", default="mono")
    p.add_argument("-max", type=int, default=10_000, help="hits that are printed at most")
    p.add_argument("-serve", action="store_true", help="answer requests on standard input")
    a = p.parse_args(args)
    if a.serve:
        serve(sys.stdin, sys.stdout)
        return 0
    if a.list_fingerprints:
        print("\n".join(available_fingerprints()))
        return 0
    if not a.store:
        p.error("a store is needed")
    from pyspark.sql import SparkSession

    from chemlattice.session import session
    from chemlattice.store import MoleculeStore

    spark = SparkSession.getActiveSession() or session()
    store = MoleculeStore(spark, a.store)
    names = a.fingerprint.split(",")
    if a.create:
        store.create(names)
    if a.insert:
        read, inserted = store.insert_file(a.insert, not a.not_unique)
        print(f"{read} read, {inserted} inserted")
    if a.add_fingerprint:
        store.add_fingerprint(a.add_fingerprint)
    if a.info:
        for r in store.information().collect():
            print(f"{r['item']}: {r['value']}")
    if a.query:
        hits = {
            "exact": lambda: store.exact(a.query), "screen": lambda: store.screen(a.query, names, a.max), "similar": lambda: store.similar(a.query, a.Smin, names, limit=a.max),
            "full": lambda: store.substructure(a.query, a.algorithm, a.max), "quick": lambda: store.quick_substructure(a.query, None, a.algorithm, a.max),
        }[a.search]()
        for r in hits.toLocalIterator():
            print(*r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
