"""Providers of predicted ligands: what they are asked, what their results depend on, and how they are kept.

A provider is a search over some tables with its settings.  Its request says what a cache may reuse: the settings and the
fingerprint of the tables, and the score band.  All proteins of a call are computed in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learned import learned_search
from ..operators.predicted import predicted_ligands, representative_seeds, seeds_of
from .cache import Cache, CacheError, Request, signature_of


@dataclass(frozen=True)
class Provider:
    """The tables that a search reads, its settings and its score band."""

    tables: dict[str, DataFrame] = field(hash=False)
    settings: dict = field(hash=False)
    minimum: float = 0.5
    maximum: float | None = None
    top: int | None = 10_000

    score = "score"
    name = "provider"

    def request(self) -> Request:
        """The limits of a search belong to what it is: other limits are another search."""
        return Request(signature_of(self.tables, provider=self.name, top=self.top, **self.settings), self.minimum, self.maximum)

    def band(self, minimum: float, maximum: float | None = None) -> Provider:
        return replace(self, minimum=minimum, maximum=maximum)

    def compute(self, proteins: DataFrame) -> DataFrame:
        raise NotImplementedError


class SimilarityProvider(Provider):
    """Compounds like a protein's known ligands (Tanimoto).  tables: known (uniprot_id, chem_comp_id, pchembl), vectors
    (chem_comp_id, words, bitcount), targets (target_id, words, bitcount), compounds (lig_idx, chem_comp_id, smiles).
    settings: prefix; limit and cluster choose representatives of a protein's ligands (limit None: all ligands)."""

    score = "tanimoto"
    name = "similarity"

    def compute(self, proteins: DataFrame) -> DataFrame:
        known = self.tables["known"].join(proteins, "uniprot_id", "left_semi")
        seeds = seeds_of(known, self.tables["vectors"])
        if self.settings.get("limit") is not None:
            seeds = representative_seeds(seeds, self.settings.get("cluster", 0.8), self.settings["limit"])
        return predicted_ligands(seeds, self.tables["targets"], self.tables["compounds"], self.minimum, self.maximum, self.top, prefix=self.settings.get("prefix", ""))


class LearnedProvider(Provider):
    """Compounds that the model of a protein's best domain prefers.  tables: domains, registry, models, known, vectors,
    targets, compounds (see ``learned_search``).  settings: dim, prefix, limit, cluster."""

    score = "bsi_score"
    name = "learned"

    def compute(self, proteins: DataFrame) -> DataFrame:
        t, s = self.tables, self.settings
        known = t["known"].join(proteins, "uniprot_id", "left_semi")
        rows = learned_search(
            t["domains"], t["registry"], t["models"], known, t["vectors"], t["targets"], t["compounds"], s["dim"], self.minimum, s.get("limit", 10), s.get("cluster", 0.8), top=self.top, prefix=s.get("prefix", "")
        )
        return rows if self.maximum is None else rows.where(F.col(self.score) <= self.maximum)


def cached(cache: Cache, provider: Provider, proteins: DataFrame, read_only: bool = False, rebuild: bool = False) -> DataFrame:
    """The provider's rows for the proteins, from the cache where it has them."""
    return cache.fetch(provider.request(), proteins, provider.compute, read_only, rebuild)


def precompute(cache: Cache, provider: Provider, proteins: DataFrame, batches: int = 1, rebuild: bool = False) -> int:
    """Fill the cache with all proteins, a share of them at a time, so that a run that stops goes on where it stopped.
    Returns how many proteins it has; raises CacheError if any is missing afterwards."""
    wanted = proteins.select(cache.key).where(F.col(cache.key).isNotNull()).distinct()
    request = provider.request()
    for i in range(batches):
        part = wanted.where(F.pmod(F.xxhash64(cache.key), F.lit(batches)) == i)
        cache.fetch(request, part, provider.compute, rebuild=rebuild and i == 0)
    name = cache.find(request, wanted)
    missing = wanted.count() if name is None else cache.missing(name, wanted)
    if missing:
        raise CacheError(f"{missing} proteins are missing after the precompute")
    return wanted.count()
