"""URL filters: a trie over reversed host labels and path text, broadcast, longest match wins.

A rule is ``(action, host, path)``.  It fits a url whose host is the rule's host or one of its subdomains and
whose path starts with the rule's path.  Among the rules that fit, the one with the most host labels wins, then
the one with the longest path; a url that no rule fits gets the default verdict.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased (user info and
ports stay part of it).  Path: what follows up to ``?``, ``#`` or the end, the leading slash included.

Edge cases: a null url, an empty one or one without ``://`` has an empty host and an empty path and gets the
default verdict; repeated rows are judged one by one; an empty table gives an empty result; extra columns pass
through, except those that carry the name of a result column, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The trie is sent to every executor, so rule sets above this many entries are refused.
MAX_RULES = 2_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


class HostPathTrie:
    """Host labels from the last to the first, and below each host a trie of path segments.

    A path is a list of segments split at slashes; the last segment of a rule may be a prefix of the url's
    segment, so each path node holds its whole segments as children and its open ends by text.
    """

    def __init__(self, rules: Iterable[Rule], default: str = "allow"):
        self.default = default
        self.root: dict = {}
        n = 0
        for rule in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if rule.action not in ("allow", "block"):
                raise ValueError(f"unknown action {rule.action!r}")
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # None: the path trie of this host
            *whole, end = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("seg", segment), {})
            node.setdefault(("end",), {})[end] = (rule.action, rule.text)

    @staticmethod
    def _deepest(node: dict, path: str):
        """The entry with the longest path that ``path`` starts with, or None."""
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            ends = node.get(("end",))
            if ends:
                for cut in range(len(segment), -1, -1):
                    if (hit := ends.get(segment[:cut])) is not None:
                        best = hit
                        break
            # a segment counts as whole only where a slash follows it
            node = node.get(("seg", segment)) if i + 1 < len(segments) else None
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """``(rule text or None, verdict)``."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            if paths and (hit := self._deepest(paths, path)) is not None:
                best = hit
        return (best[1], best[0]) if best else (None, self.default)


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` added.

    One narrow pass: no shuffle; the trie travels with a broadcast variable.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(HostPathTrie(rules, default))
    added = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in added]
    if url_col in added:
        raise ValueError(f"the url column cannot be named {url_col!r}")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in added])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.schema.get_field_index(url_col)).to_pylist()]
            found = [t.judge(h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=[*keep, *added]
            )

    return pages.select(*[f"`{c}`" for c in keep]).mapInArrow(judge, schema)
