"""Parameters, with their defaults and validation."""

from __future__ import annotations

import logging
from dataclasses import dataclass

log = logging.getLogger("varloom")


@dataclass(frozen=True)
class PileupParams:
    """Indexing reads into pileups."""

    sizemin: int = 50
    sizemax: int = 10_000
    mapq: int = 5
    mapflag: int = 3840
    chunk_mbp: int = 25

    def validate(self) -> PileupParams:
        if self.sizemin < 20:
            log.warning("sizemin is recommended to be at least 20")
        return self


@dataclass(frozen=True)
class GenotypeParams:
    """Genotyping known variants."""

    passonly: bool = False
    neighdist: int = 1000
    sizemin: int = 50
    sizemax: int = 10_000
    mapq: int = 5
    mapflag: int = 3840
    hps_weight: float = 1.0
    seqsim: float = 0.90
    sizesim: float = 0.90
    hapsim: float = 1.0
    gpenalty: float = 0.02
    fpenalty: float = 0.10
    kmer: int = 4
    minkfreq: int = 2
    maxnodes: int = 5000
    maxpaths: int = 5000
    pileupmax: int = 100
    fnmax: int = 3
    one_to_one: bool = False
    maxhom: int = 0
    squish: bool = False
    ab: float = 0.0

    def validate(self) -> GenotypeParams:
        bad = []
        if self.kmer < 1:
            bad.append("kmer must be at least 1")
        if self.sizemin < self.kmer:
            bad.append("sizemin must be at least kmer")
        bad += [f"{n} must be in [0, 1]" for n in ("seqsim", "sizesim", "hapsim") if not 0 <= getattr(self, n) <= 1]
        if self.maxpaths < 1:
            bad.append("maxpaths must be at least 1")
        if bad:
            raise ValueError("; ".join(bad))
        if self.sizemin < 10:
            log.warning("sizemin below 10 is not recommended")
        if self.kmer >= 8:
            log.warning("kmer of 8 or more needs much memory")
        return self

    def index_mismatches(self, made_with: dict) -> list[str]:
        """Names of the parameters an index was made with that differ from these; a warning each."""
        names = [n for n in ("sizemin", "sizemax", "mapq", "mapflag") if n in made_with and made_with[n] != getattr(self, n)]
        for n in names:
            log.warning("index made with %s %s, genotyping with %s", n, made_with[n], getattr(self, n))
        return names
