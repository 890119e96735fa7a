"""Mail that is due, as a stream: a user's waiting items are state, and timers send them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .batches import DAILY, DIGEST_HOUR, WAIT

#: What is kept of a user besides instant items by their second: items that wait for the digest and the second at which it falls due, the local day and the mails sent on it, zone and quiet hours.
_STATE = StructType(
    [StructField(n, LongType()) for n in ("digest", "slot", "day", "sent")] + [StructField("zone", StringType()), StructField("quiet_from", IntegerType()), StructField("quiet_to", IntegerType())]
)
_UTC = dt.timezone.utc


def _quiet(hour: int, first: int, last: int) -> bool:
    return first != last and (first <= hour < last if first < last else hour >= first or hour < last)


class _Mail(StatefulProcessor):
    """A batch goes WAIT minutes after its first item, the digest at DIGEST_HOUR, neither in quiet hours, DAILY a day; without room a batch goes to the digest. While a digest is
    ahead that day, the last mail is its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _STATE)
        self.instant = handle.getMapState("instant", StructType([StructField("second", LongType())]), StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, reached = self._read(), timerValues.getCurrentWatermarkInMs() // 1000
        for frame in rows:
            for kind, since, zone, first, last in zip(frame["kind"], frame["since"], frame["zone"], frame["quiet_from"], frame["quiet_to"], strict=True):
                second = int(pd.Timestamp(since).timestamp())
                s |= {"zone": zone, "quiet_from": int(first), "quiet_to": int(last)}
                if kind == "instant":
                    had = self.instant.getValue((second,))[0] if self.instant.containsKey((second,)) else 0
                    self.instant.updateValue((second,), (had + 1,))
                    self._wake(max(second + WAIT * 60, reached + 1))
                else:
                    self._put_off(s, 1, max(second, reached))
        self._keep(s)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, now, out = self._read(), expiredTimerInfo.getExpiryTimeInMs() // 1000, []
        here = dt.datetime.fromtimestamp(now, _UTC).astimezone(ZoneInfo(s["zone"]))
        if _quiet(here.hour, s["quiet_from"], s["quiet_to"]):
            self._wake(self._at(s, now, s["quiet_to"]))  # when the quiet hours end
        else:
            if s["day"] != here.toordinal():
                s["day"], s["sent"] = here.toordinal(), 0
            if s["digest"] and now >= s["slot"]:
                if s["sent"] < DAILY:
                    out.append(("digest", s["digest"]))
                    s["digest"], s["slot"], s["sent"] = 0, 0, s["sent"] + 1
                else:
                    self._wake(self._at(s, now, 0))  # the next day's first
            waiting = {k[0]: v[0] for k, v in self.instant.iterator()}
            if waiting and min(waiting) + WAIT * 60 <= now:
                taken = [k for k in waiting if k <= now]  # what came by now; later items are another batch's
                items = sum(waiting[k] for k in taken)
                ahead = bool(s["digest"]) and now < s["slot"] <= self._at(s, now, 0)
                if s["sent"] + ahead < DAILY:
                    out.append(("batch", items))
                    s["sent"] += 1
                else:
                    out.append(("to_digest", items))
                    self._put_off(s, items, now)
                for k in taken:
                    self.instant.removeKey((k,))
            self._keep(s)
        yield self._rows([(key[0], action, items, pd.Timestamp(now, unit="s")) for action, items in out])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "action", "items", "at"]).astype({"user_id": "int64", "action": "object", "items": "int64", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        if self.kept.exists():
            return dict(zip(_STATE.names, self.kept.get(), strict=True))
        return dict.fromkeys(("digest", "slot", "day", "sent"), 0) | {"zone": "UTC", "quiet_from": 0, "quiet_to": 0}

    def _keep(self, s: dict) -> None:
        self.kept.update(tuple(s[n] for n in _STATE.names))

    def _put_off(self, s: dict, items: int, now: int) -> None:
        """Items for the digest, which falls due at the next DIGEST_HOUR if it has none yet."""
        s["digest"] += items
        if not s["slot"]:
            s["slot"] = self._at(s, now, DIGEST_HOUR)
            self._wake(s["slot"])

    def _wake(self, second: int) -> None:
        self.handle.registerTimer(second * 1000)

    @staticmethod
    def _at(s: dict, now: int, hour: int) -> int:
        """The next time that the user's clock shows the hour, after now."""
        here = dt.datetime.fromtimestamp(max(now, 0), _UTC).astimezone(ZoneInfo(s["zone"]))
        then = here.replace(hour=hour, minute=0, second=0, microsecond=0)
        return int((then if then > here else then + dt.timedelta(days=1)).timestamp())


def mail_stream(items: DataFrame, late: str = "0 seconds") -> DataFrame:
    """items, a stream of user_id, kind (instant or digest), since, zone, quiet_from, quiet_to, to user_id, action (digest, batch, to_digest), items, at.

    Time is that of the items: a timer goes off when the watermark, `late` behind the newest item, has passed it. State is what waits, by its second, and a few numbers for each user.
    Needs the RocksDB state store.
    """
    timed = items.withWatermark("since", late)
    return timed.groupBy("user_id").transformWithStateInPandas(_Mail(), "user_id long, action string, items long, at timestamp", "append", "eventtime")
