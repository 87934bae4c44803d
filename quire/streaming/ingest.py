"""Uploads as they arrive: a request that is repeated gets its first answer, and content that is known no second document.

Uploads are taken in order of event time (ties by id; see `ordered`). A request key is held by the first upload that
brings it, for a time; uploads that bring it again within that time are replays, whatever they contain. Of the
others (an upload without a key is never a replay), the first with a digest creates a document, and those that bring the digest within
another time are deduplicated: they get that document's id. A replay gets the document of the upload that holds its key.

There are two processors, by request key and by digest, so neither is bound to a key that all uploads share; what either
keeps goes when its time to live is over.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.streaming.ordered import SECOND, InOrder, dealt, with_time


class Requests(InOrder):
    """By request key: which upload holds it, and with what digest."""

    KEY, WAITING, STATE = "asked string", "at long, id long, digest string, keyed boolean", "id long, digest string, until long"
    OUT = ["asked", "at", "id", "holder", "digest", "keyed"]
    SCHEMA = "asked string, time timestamp, at long, id long, holder long, digest string, keyed boolean"

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * SECOND

    def wakes(self, state: tuple) -> int:
        return state[2]

    def frame(self, found: list[tuple]) -> pd.DataFrame:
        out = super().frame(found)
        out.insert(1, "time", pd.to_datetime(out["at"], unit="us"))
        return out

    def passed(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple | None, list[tuple]]:
        holder, out = state, []
        for at, upload, digest, keyed in rows:
            if holder is None or at >= holder[2]:
                holder = (upload, digest, at + self.ttl)
            out.append((*key, at, upload, holder[0], holder[1], keyed))
        kept = holder is not None and holder[2] > upto and (not rows or rows[-1][3])
        return holder if kept else None, out


class Digests(InOrder):
    """By digest: its document, and of the uploads that hold a request key the documents that they were answered with."""

    KEY, WAITING = "digest string", "at long, id long, holder long, keyed boolean"
    STATE = "document long, until long, holders array<bigint>, answers array<bigint>, untils array<bigint>"
    OUT = ["digest", "at", "id", "outcome", "document"]
    SCHEMA = "digest string, at long, id long, outcome string, document long"

    def __init__(self, ttl_s: int, request_ttl_s: int):
        self.ttl, self.request_ttl = ttl_s * SECOND, request_ttl_s * SECOND

    def wakes(self, state: tuple) -> int:
        """When the document is over; after that, when the last answer is."""
        return state[1] if state[1] is not None else max(state[4])

    def passed(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple | None, list[tuple]]:
        document, until, *held = state or (None, None, [], [], [])
        answers, out = {h: (d, t) for h, d, t in zip(*held, strict=True)}, []
        for at, upload, holder, keyed in rows:
            if holder != upload:
                out.append((*key, at, upload, "replayed", answers[holder][0]))
                continue
            known = until is not None and at < until
            if not known:
                document, until = upload, at + self.ttl
            if keyed:
                answers[upload] = document, at + self.request_ttl
            out.append((*key, at, upload, "deduplicated" if known else "created", document))
        left = [(h, d, t) for h, (d, t) in answers.items() if t > upto]
        if until is not None and until <= upto:
            document = until = None
        return (document, until, *([r[i] for r in left] for i in range(3))) if left or until is not None else None, out


def ingest(uploads: DataFrame, delay: str = "1 hour", ttl_s: int = 30 * 86400, request_ttl_s: int = 86400) -> DataFrame:
    """uploads: id, request_key (null: none), sha256, created_at. Per upload: id, at, outcome (created, deduplicated
    or replayed) and the document that it is answered with. Needs the RocksDB state store."""
    asked = F.when(F.col("request_key").isNull(), F.concat(F.lit("upload "), "id")).otherwise(F.concat(F.lit("key "), "request_key"))
    rows = with_time(uploads, "created_at", asked.alias("asked"), "id", F.col("sha256").alias("digest"), F.col("request_key").isNotNull().alias("keyed")).withWatermark("time", delay)
    held = dealt(rows, "asked").transformWithStateInPandas(statefulProcessor=Requests(request_ttl_s), outputStructType=Requests.SCHEMA, outputMode="Append", timeMode="EventTime", eventTimeColumnName="time")
    told = dealt(held, "digest").transformWithStateInPandas(statefulProcessor=Digests(ttl_s, request_ttl_s), outputStructType=Digests.SCHEMA, outputMode="Append", timeMode="EventTime")
    return told.select("id", "at", "outcome", "document")
