"""All registered queries of the text operators."""

from skywell.llm import classifier, collocations, edits, fingerprints, jaccard, languages, packing, rules, sentences, sharding, simhash, suffixes, variants  # noqa: F401
from skywell.llm.registry import QUERIES, SQL  # noqa: F401
