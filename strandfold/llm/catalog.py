"""Imports every module that registers a query of this subpackage."""

from strandfold.llm import bpe, decontaminate, langid, mixing, orderhash, paragraphs, phrases, secret_scan, simhash, suffixes, turn_trie, urls, warc  # noqa: F401
from strandfold.llm.common import QUERIES, SQL  # noqa: F401
