"""The greedy rule of displayed postings (D7) over rows in order, with indices in place of pairs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa

ANY = None  # in an index: every company, or every place


class Shown:
    """The kept postings of one group, by the place in which each was first kept.

    A posting is (company, title, place, stable, url, named), what D6 compares. Each index has the places of the kept postings of a key,
    smallest first; an entry of a posting that another one has replaced since is known by its version.
    """

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.ranks: list[float] = []
        self.postings: list[tuple] = []
        self.versions: list[int] = []
        self.index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        # Of a company and title: the sites of kept postings without stable id, and for sites asked for those that hold them or that they hold.
        self.sites: dict[tuple, tuple[set[str], dict[str, list[str]]]] = defaultdict(lambda: (set(), {}))

    def _write(self, at: int) -> None:
        company, title, site, stable, url, named = self.postings[at]
        keys = []
        for c in {company, ANY}:
            if stable:
                keys.append(("s", stable, c))
            if named and url:
                keys.append(("u", url, title, c, stable != ""))
        if named and company:
            keys.append(("r", company, title, site, stable != ""))
            if not stable:
                keys.append(("r", company, title, ANY, False))
                known, near = self.sites[company, title]
                if site not in known:
                    known.add(site)
                    for other, found in near.items():
                        if site in other or other in site:
                            found.append(site)
        for key in keys:
            heappush(self.index[key], (at, self.versions[at]))

    def _first(self, posting: tuple) -> int | None:
        """The smallest place of a kept posting that D6 takes for the same."""
        company, title, site, stable, url, named = posting
        keys = []
        for c in (company, "") if company else (ANY,):
            if stable:
                keys.append(("s", stable, c))
            if named and url:
                keys += [("u", url, title, c, has) for has in ((False,) if stable else (False, True))]
        if named and company:
            if stable:
                keys.append(("r", company, title, site, False))
            else:
                keys.append(("r", company, title, site, True))
                if site:
                    known, near = self.sites[company, title]
                    if site not in near:
                        near[site] = [x for x in known if x in site or site in x]
                    keys += [("r", company, title, x, False) for x in near[site]]
                else:
                    keys.append(("r", company, title, ANY, False))
        best = None
        for key in keys:
            heap = self.index.get(key)
            while heap and self.versions[heap[0][0]] != heap[0][1]:
                heappop(heap)
            if heap and (best is None or heap[0][0] < best):
                best = heap[0][0]
        return best

    def meet(self, ident: int, rank: float, posting: tuple) -> None:
        """The next row joins the first kept one that is the same, and replaces it if its rank is higher; else it is kept."""
        at = self._first(posting)
        if at is None:
            self.ids.append(ident)
            self.ranks.append(rank)
            self.postings.append(posting)
            self.versions.append(0)
            self._write(len(self.ids) - 1)
        elif rank > self.ranks[at]:
            self.ids[at], self.ranks[at] = ident, rank
            if posting != self.postings[at]:
                self.postings[at] = posting
                self.versions[at] += 1
                self._write(at)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the postings kept, of rows (root, id, rank, company, title, place, stable, url, named) sorted by root, then in the rule's order."""
    root, shown = None, Shown()
    for batch in batches:
        done: list[int] = []
        for r, ident, rank, *posting in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r != root:
                done += shown.ids
                root, shown = r, Shown()
            shown.meet(ident, float("nan") if rank is None else rank, tuple(posting))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["id"])
    yield pa.RecordBatch.from_arrays([pa.array(shown.ids, pa.int64())], names=["id"])
