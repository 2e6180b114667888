"""Opening indexes by handle: what a handle means, where its index lives, and which ones a session keeps."""

from __future__ import annotations

import hashlib
import os
from collections import OrderedDict
from typing import NamedTuple

from pyspark.sql import SparkSession

from quernal.operators import dense
from quernal.plans.index import SearchIndex
from quernal.plans.render import human_size
from quernal.plans.storage import Folder
from quernal.plans.store import Store
from quernal.sources.files import cloned, is_git_url

MOST_OPEN = 10
VERSION = "v1"
ROOT_VARIABLE, NO_CACHE = "QUERNAL_CACHE_DIR", "none"
LEDGER_VARIABLE = "QUERNAL_LEDGER"
ENCODER_VARIABLE, DEFAULT_ENCODER = "QUERNAL_ENCODER", "hash"


class Source(NamedTuple):
    """A handle made canonical: ``key`` tells indexes apart, ``handle`` is what is opened."""

    key: str
    handle: str
    ref: str | None


def resolve_source(handle: str, ref: str | None = None) -> Source:
    """url@ref, url, or the canonical path; a path that doesn't exist is an error."""
    if is_git_url(handle):
        return Source(f"{handle}@{ref}" if ref else handle, handle, ref)
    if not os.path.exists(handle):
        raise ValueError(f"no such path: {handle}")
    path = os.path.realpath(handle)
    return Source(path, path, None)


def choose_source(asked: str | None, default: str | None) -> str:
    """What a call names, else the session's default, else the working folder."""
    return asked or default or os.getcwd()


def resolve_encoder(flag: str | None = None, environment: str | None = None) -> str:
    """Environment over flag over default; empty strings don't count, white space does."""
    environment = os.environ.get(ENCODER_VARIABLE) if environment is None else environment
    return environment or flag or DEFAULT_ENCODER


def cache_root() -> str | None:
    """The folder of all indexes; None if caching is switched off."""
    named = os.environ.get(ROOT_VARIABLE)
    return None if named == NO_CACHE else named or os.path.join(os.path.expanduser("~"), ".cache", "quernal")


def ledger_path(asked: str | None = None) -> str | None:
    """Where the command line logs what searches save: what a call names, else the environment, else a place in the user's
    home; None if it is switched off by ``none``."""
    named = asked or os.environ.get(LEDGER_VARIABLE) or os.path.join(os.path.expanduser("~"), ".quernal", "savings")
    return None if named == NO_CACHE else named


def cache_dir(root: str, source: Source, include_text: bool, encoder: str) -> str:
    digest = hashlib.sha256(f"{source.key}|{include_text}|{encoder}".encode()).hexdigest()
    return os.path.join(root, f"{digest}-{VERSION}")


def dir_size(spark: SparkSession, folder: str) -> int:
    return Folder(spark, folder).size()


def status(spark: SparkSession, root: str | None) -> str:
    """How many indexes there are, and how large."""
    if root is None:
        return "caching is switched off"
    folder = Folder(spark, root)
    return f"{len(folder.names())} indexes, {human_size(folder.size())} in {root}"


def info(spark: SparkSession, root: str | None, source: Source, include_text: bool = False, encoder: str = DEFAULT_ENCODER) -> str:
    """Is a source's index there, how large is it, how many files are in it, when was it written."""
    lines = [f"source    {source.key}", f"encoder   {encoder}"]
    if root is None:
        return "\n".join([*lines, "caching is switched off"])
    home = cache_dir(root, source, include_text, encoder)
    state = SearchIndex.state(spark, home)
    lines.append(f"cache     {home}")
    if state is None:
        return "\n".join([*lines, "status    not cached"])
    files = Store(spark, home).live("manifest", state).count()
    return "\n".join([*lines, "status    cached", f"size      {human_size(Folder(spark, home).size())}", f"files     {files}", f"modified  {int(state.at)}"])


def clear(spark: SparkSession, root: str, source: Source | None = None, include_text: bool = False, encoder: str = DEFAULT_ENCODER) -> None:
    """Delete one index, or all; nothing there is no error."""
    Folder(spark, root if source is None else cache_dir(root, source, include_text, encoder)).delete()


def load_encoder(spark: SparkSession, named: str) -> dense.Encoder:
    """``hash``, or the path of a table: of subwords, if it has a column ``piece``, else of tokens."""
    if named == DEFAULT_ENCODER:
        return dense.HashEncoder()
    kind = dense.SubwordEncoder if "piece" in spark.read.parquet(named).columns else dense.TableEncoder
    return kind.load(spark, named)


class Session:
    """Open indexes, at most MOST_OPEN; the one used longest ago goes first.  Without a ``root`` nothing is kept on disk."""

    def __init__(self, spark: SparkSession, root: str | None, most: int = MOST_OPEN, encoder: str | None = None, clones: str | None = None, ledger: str | None = None):
        self.spark, self.root, self.most, self.named, self.clones, self.ledger = spark, root, most, resolve_encoder(encoder), clones, ledger
        self.held: OrderedDict[tuple, SearchIndex] = OrderedDict()

    def get(self, handle: str, ref: str | None = None, include_text: bool = False) -> SearchIndex:
        source = resolve_source(handle, ref)
        held = (source.key, include_text, self.named)
        if held not in self.held:
            self.held[held] = self._open(source, include_text)
        self.held.move_to_end(held)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[held]

    def _open(self, source: Source, include_text: bool) -> SearchIndex:
        more = {"encoder": load_encoder(self.spark, self.named), "ledger": self.ledger}
        home = self.root and cache_dir(self.root, source, include_text, self.named)

        def build(tree: str) -> SearchIndex:
            if home is None:
                return SearchIndex.of_tree(self.spark, tree, include_text, **more)
            return SearchIndex.refresh(self.spark, tree, home, include_text, **more)

        if not is_git_url(source.handle):
            return build(source.handle)
        index = SearchIndex.open(self.spark, home, root=None, **more) if home else None
        if index is None:
            with cloned(source.handle, source.ref, self.clones) as tree:
                index = build(tree)
            index.root = None  # the clone is gone
        return index
