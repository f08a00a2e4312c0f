"""Living members as a stored view: each batch goes on from the stored lives, and only the buckets of members it touches
are written anew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.operators import ledger
from poolscope.sources.commits import CommitLog, Part

MEMBERS = "members"
EVENTS = ("stake_events", "unstake_events", "pending_liquidity_events")
#: Members are kept in so many parts by the hash of member and pool.
BUCKETS = 64
KEY = ["member_id", "pool"]


class MemberStore:
    """Members under a commit log, which may hold other tables beside them."""

    tables = (MEMBERS,)

    def __init__(self, log: CommitLog, buckets: int = BUCKETS):
        self.log, self.buckets = log, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets))

    def _touched(self, changes: DataFrame) -> list[Part]:
        keys = {r[0] for r in changes.select(self._bucket()).distinct().collect()}
        return [p for p in self.log.parts(MEMBERS) if p.key in keys]

    def staged(self, tables: Mapping[str, DataFrame]) -> tuple[list[Part], list[Part]]:
        """Parts to add and to remove for a batch of stakes, unstakes and pending liquidity, later than those before."""
        changes = ledger.member_changes(*(tables[name] for name in EVENTS))
        old = self._touched(changes)
        rows = ledger.members(changes, self.log.read_parts(MEMBERS, old) if old else None)
        return self.log.stage(MEMBERS, rows, self._bucket(), KEY), old

    def apply(self, tables: Mapping[str, DataFrame], epoch: str | None = None, also: Mapping[str, DataFrame] | None = None) -> bool:
        """Bring the members up to a batch of whole blocks; `also` are tables that are appended in the same commit."""
        if epoch is not None and epoch in self.log.epochs:
            return False
        add, remove = self.staged(tables)
        for name, rows in (also or {}).items():
            add += self.log.stage(name, rows)
        self.log.commit(add, remove, epoch)
        return True

    def read(self) -> DataFrame:
        return self.log.read_parts(MEMBERS, self.log.parts(MEMBERS))

    def trimmed(self, timestamp: int) -> tuple[list[Part], list[Part]]:
        """Members with changes at or after the time are folded anew from the log's event tables; the others stay."""
        late = ledger.member_changes(*(self.log.read(name, timestamp) for name in EVENTS)).select(*KEY).distinct()
        early = ledger.member_changes(*(self.log.read(name, end_ns=timestamp) for name in EVENTS))
        buckets = {r[0] for r in late.select(self._bucket()).distinct().collect()}
        old = [p for p in self.log.parts(MEMBERS) if p.key in buckets]
        again = ledger.members(early.join(late, KEY, "left_semi"))
        if old:
            again = again.unionByName(self.log.read_parts(MEMBERS, old).join(late, KEY, "left_anti"))
        return self.log.stage(MEMBERS, again, self._bucket(), KEY), old
