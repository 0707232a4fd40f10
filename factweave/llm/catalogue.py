"""All queries of this subpackage: importing the operator modules fills the registry."""

from . import bitplanes, idfiles, infilling, jaccard, langid, mixing, packing, pii, pivots, postings, sharding, warc, windows  # noqa: F401
from .tables import QUERIES, SQL  # noqa: F401
