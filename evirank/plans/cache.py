"""Results kept between runs, and reused for requests that they cover.

A cache entry is a folder: hits/ and ledger/ (Parquet; the ledger names the proteins that were done, also those without a
hit) and manifest.json.  Both tables are made of batches, each a folder ``batch_id=..`` that is written as a whole.  A
batch's id is the fingerprint of the proteins it was asked for, so one that is tried again replaces itself; and rows
count only if the ledger has their protein under their batch, so a batch that ended between the two writes is not seen.
The driver reads manifests only; rows stay in Spark.  The root may be in any file system that Spark reads.
"""

from __future__ import annotations

import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import database_fingerprint, table_fingerprint
from ..functions.files import Folder
from ..functions.text import fingerprint
from ..operators.ranking import keep_first, order

#: The part of a signature that says what the data were.
DATABASE = "database"


@dataclass(frozen=True)
class Request:
    """What is asked: a method's signature and its score band."""

    signature: dict = field(hash=False)
    minimum: float = 0.0
    maximum: float | None = None

    def namespace(self) -> str:
        return fingerprint(asdict(self))[:16]


def covers(have: Request, want: Request) -> bool:
    """The same signature, a minimum that is no higher, and no maximum or one that is no lower."""
    if have.signature != want.signature or have.minimum > want.minimum:
        return False
    return have.maximum is None or (want.maximum is not None and have.maximum >= want.maximum)


def select(entries: list[tuple[Request, int]], want: Request) -> int | None:
    """Of the entries that cover a request, each with how many of its proteins it has, the index of the best: most
    proteins, then the highest minimum, then the lowest maximum."""
    able = [i for i, (have, _) in enumerate(entries) if covers(have, want)]
    top = lambda r: float("inf") if r.maximum is None else r.maximum
    return min(able, key=lambda i: (-entries[i][1], -entries[i][0].minimum, top(entries[i][0])), default=None)


def best_entries(entries: DataFrame, wants: DataFrame) -> DataFrame:
    """``select`` for a table of requests: each wanted request with the entry_id of the entry to reuse, null if none covers
    it.  entries: entry_id, signature, minimum, maximum, n_done.  wants: want_id, signature, minimum, maximum.  A null
    maximum is none; entries equal in all are told apart by the smallest entry_id."""
    e = entries.select("entry_id", F.col("signature").alias("__signature"), F.col("minimum").alias("__low"), F.col("maximum").alias("__high"), "n_done")
    on = (F.col("signature") == F.col("__signature")) & (F.col("__low") <= F.col("minimum")) & F.coalesce(F.col("__high") >= F.col("maximum"), F.col("__high").isNull())
    found = wants.join(e, on, "left").withColumn("__top", F.coalesce("__high", F.lit(float("inf"))))
    return keep_first(found, ["want_id"], order("-n_done", "-__low", "__top", "entry_id")).select("want_id", "entry_id")


def signature_of(tables: dict[str, DataFrame], **settings: object) -> dict:
    """A request's signature: its settings and the fingerprint of the tables that the results come from."""
    return settings | {DATABASE: database_fingerprint(tables)}


class CacheError(ValueError):
    """A read-only cache is missing, incompatible or incomplete."""


#: Seconds after which a lock that its owner does not renew may be taken over.
LEASE = 60.0


class Cache:
    """Entries below one folder."""

    def __init__(self, spark: SparkSession, root: str, score: str = "tanimoto", key: str = "uniprot_id"):
        self.spark, self.root, self.score, self.key = spark, root.rstrip("/"), score, key
        self.folder = Folder(spark, self.root)

    def _manifest(self, name: str) -> Request | None:
        held = self.folder.read(f"{name}/manifest.json")
        try:
            return None if held is None else Request(**held)
        except TypeError:
            return None

    def entries(self) -> list[tuple[str, Request]]:
        return [(n, r) for n in self.folder.names() if not n.startswith(".") and (r := self._manifest(n))]

    def _ledger(self, name: str) -> DataFrame:
        """Each protein that was done, with the batch whose rows count."""
        rows = self.spark.read.parquet(self.folder.at(f"{name}/ledger"))
        return rows.groupBy(self.key).agg(F.min("batch_id").alias("batch_id"))

    def _done(self, name: str) -> DataFrame:
        return self._ledger(name).select(self.key)

    @staticmethod
    def _writer(want: Request) -> str:
        """The name of the lock: entries of other signatures never serve each other."""
        return f"writer-{fingerprint(want.signature)[:16]}"

    def find(self, want: Request, proteins: DataFrame) -> str | None:
        """The entry to reuse for a request, if any."""
        able = [(n, r) for n, r in self.entries() if covers(r, want)]
        counted = [(r, self._done(n).join(proteins, self.key, "left_semi").count()) for n, r in able]
        at = select(counted, want)
        return None if at is None else able[at][0]

    @contextmanager
    def lock(self, name: str, timeout: float = 900.0) -> Iterator[None]:
        """One writer at a time.  The owner renews its lease; a lock whose lease has run out is taken over, and on the
        owner's own host also one whose process is gone."""
        path, me = f"{name}.lock", uuid.uuid4().hex
        mine = lambda: {"owner": me, "host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + LEASE}
        end = time.time() + timeout
        while not self.folder.create(path, mine()):
            held = self.folder.read(path)
            if held is not None and self._expired(held):
                self._take_over(path, held)
                continue
            if time.time() > end:
                raise TimeoutError(f"{self.folder.at(path)} is held by another writer")
            time.sleep(0.2)
        over = threading.Event()

        def renew() -> None:
            while not over.wait(LEASE / 3):
                self.folder.write(path, mine())

        renewing = threading.Thread(target=renew, daemon=True)
        renewing.start()
        try:
            yield
        finally:
            over.set()
            renewing.join()
            self.folder.delete(path)

    def _take_over(self, path: str, held: dict) -> None:
        """Put a lock that has run out aside.  Of several that try one succeeds; a lock that is no longer the one that was
        read goes back."""
        aside = f".{path}.{uuid.uuid4().hex}"
        with suppress(OSError, Py4JJavaError):
            self.folder.move(path, aside)
            if (self.folder.read(aside) or {}).get("owner") != held.get("owner"):
                self.folder.move(aside, path)

    @staticmethod
    def _expired(held: dict) -> bool:
        if held.get("until", 0) < time.time():
            return True
        if held.get("host") != socket.gethostname():
            return False  # another host's process numbers mean nothing here
        try:
            os.kill(int(held["pid"]), 0)
        except ProcessLookupError:
            return True
        except OSError:  # it lives, but is another user's
            return False
        return False

    def fetch(self, want: Request, proteins: DataFrame, compute: Callable[[DataFrame], DataFrame], read_only: bool = False, rebuild: bool = False) -> DataFrame:
        """Hits of the proteins (column ``key``) in the request's band.

        Proteins that the chosen entry has not done are computed at once, all in one plan, appended as one batch, and
        entered in the ledger even if they have no hit.  read_only never writes and raises CacheError where it would.
        """
        if read_only and rebuild:
            raise ValueError("a forced rebuild is incompatible with a read-only cache")
        if read_only:
            name = self.find(want, proteins)
            if name is None:
                raise CacheError("no cache entry covers the request")
            if self.missing(name, proteins):
                raise CacheError("the cache lacks proteins of the request")
        else:
            with self.lock(self._writer(want)):  # the entry is chosen inside, so that two writers do not both start it
                name = (None if rebuild else self.find(want, proteins)) or want.namespace()
                self._fill(name, want, proteins, compute, rebuild)
        return self.hits(name, want, proteins)

    def hits(self, name: str, want: Request, proteins: DataFrame) -> DataFrame:
        """The rows of an entry for the proteins, those of batches that were finished."""
        asked = self._ledger(name).join(proteins.select(self.key).distinct(), self.key, "left_semi")
        rows = self.spark.read.parquet(self.folder.at(f"{name}/hits")).join(asked, [self.key, "batch_id"], "left_semi").drop("batch_id")
        inside = F.col(self.score) >= want.minimum
        return rows.where(inside if want.maximum is None else inside & (F.col(self.score) <= want.maximum))

    def _fill(self, name: str, want: Request, proteins: DataFrame, compute: Callable[[DataFrame], DataFrame], rebuild: bool) -> None:
        have = None if rebuild else self._manifest(name)
        if not have and self.folder.exists(name):
            self.folder.move(name, f".{name}.{uuid.uuid4().hex}.old")  # to be rebuilt, or never finished
        needed = proteins.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        if have:
            needed = needed.join(self._done(name), self.key, "left_anti")
            if needed.isEmpty():
                return
        self.append(name, needed, compute(needed))
        if not have:
            self.folder.write(f"{name}/manifest.json", asdict(want))

    def append(self, name: str, proteins: DataFrame, hits: DataFrame) -> str:
        """Add one batch: its hits, then its proteins.  A batch of the same proteins replaces what an earlier try of it
        left, whether that ended before, between or after the two writes.  Returns the batch's id."""
        batch = f"b{table_fingerprint(proteins.select(self.key))[:32]}"
        ordered = hits.repartitionByRange(self.key).sortWithinPartitions(self.key)
        ordered.write.mode("overwrite").parquet(self.folder.at(f"{name}/hits/batch_id={batch}"))
        self._between_writes()
        proteins.select(self.key).write.mode("overwrite").parquet(self.folder.at(f"{name}/ledger/batch_id={batch}"))
        return batch

    def _between_writes(self) -> None:
        """For tests of a crash at that place."""

    def drop_unfinished(self, name: str) -> list[str]:
        """Remove the hits of batches that never reached the ledger; returns their ids.  No writer may be at work."""
        with self.lock(self._writer(self._manifest(name))):
            batches = lambda part: {n for n in Folder(self.spark, self.folder.at(f"{name}/{part}")).names() if n.startswith("batch_id=")}
            lost = sorted(batches("hits") - batches("ledger"))
            for b in lost:
                self.folder.delete(f"{name}/hits/{b}")
        return [b.removeprefix("batch_id=") for b in lost]

    def invalidate(self, name: str) -> str | None:
        """Put an entry aside; returns where it went."""
        if self._manifest(name) is None:
            return None
        to = f".{name}.{uuid.uuid4().hex}.old"
        self.folder.move(name, to)
        return self.folder.at(to)

    def drop_stale(self, signature: dict) -> list[str]:
        """Put the entries aside whose settings are those of the signature but whose data are not; returns their names."""
        same = lambda r: {k: v for k, v in r.signature.items() if k != DATABASE} == {k: v for k, v in signature.items() if k != DATABASE}
        stale = [n for n, r in self.entries() if same(r) and r.signature.get(DATABASE) != signature.get(DATABASE)]
        return [n for n in stale if self.invalidate(n)]

    def missing(self, name: str, proteins: DataFrame) -> int:
        """How many of the proteins the entry has not done (0 after a full precompute)."""
        return proteins.select(self.key).distinct().join(self._done(name), self.key, "left_anti").count()
