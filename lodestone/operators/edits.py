"""Folds over ordered logs: region edits of a document, and review actions of an item.

Each log belongs to one key and is applied in the order of its sequence numbers, key by key. An edit that does not apply is
kept as an error row instead of ending the job.
"""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.folds import fold

#: What an action makes of an item: (status, goes to training).
ACTIONS = {"approve": ("verified", True), "return": ("needs_revision", False), "reject": ("rejected", False), "duplicate": ("duplicate", False), "license_unclear": ("license_unclear", False), "resubmit": ("pending_review", False)}
#: The columns of a region before its audit.
_PLAIN = itemgetter("document_id", "page", "region_id", "x1", "y1", "x2", "y2", "region_type", "status", "confirmed")


class _Regions:
    """Regions of a document while its edits are applied."""

    def __init__(self, document_id, width: int, height: int):
        self.document_id, self.width, self.height, self.state = document_id, width, height, {}

    def clamp(self, x1, y1, x2, y2):
        if None in (x1, y1, x2, y2):
            return None
        box = max(0, x1), max(0, y1), min(self.width, x2), min(self.height, y2)
        return box if box[2] > box[0] and box[3] > box[1] else None

    def region(self, page, region_id, x1, y1, x2, y2, kind, status, confirmed) -> dict:
        return {"document_id": self.document_id, "page": page, "region_id": region_id, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "region_type": kind, "status": status, "confirmed": confirmed, "audit": []}

    def take(self, is_edit, seq, action, region_id, other_id, page, x1, y1, x2, y2, kind, status, confirmed):
        if not is_edit:
            self.state[region_id] = self.region(page, region_id, x1, y1, x2, y2, kind, status, confirmed)
            return ()
        r, box = self.state.get(region_id), self.clamp(x1, y1, x2, y2) if action in ("add", "update") else None
        done = [r] if r else []
        if action == "confirm_page":
            done = [x for x in self.state.values() if x["page"] == page and x["status"] != "deleted"]
            for x in done:
                x.update(status="confirmed", confirmed=True)
            ok = bool(done)
        elif action == "add":
            ok = r is None and box is not None
            if ok:
                r = self.region(page, region_id, *box, kind or "molecule", "edited", False)
                self.state[region_id], done = r, [r]
        else:
            ok = r is not None and self.change(r, action, box, kind, other_id)
        for x in done:
            x["audit"].append(action if ok else action + "!")
        return ()

    def change(self, r: dict, action: str, box, kind, other_id) -> bool:
        """Apply an edit of one region; whether it could be."""
        kept = "confirmed" if r["confirmed"] else "edited"
        if action == "update":
            if box is None:
                return False
            r.update(zip(("x1", "y1", "x2", "y2"), box, strict=True), status=kept, region_type=kind or r["region_type"])
        elif action == "delete":
            r.update(status="deleted", confirmed=False, region_type="non_molecule")
        elif action == "mark":
            r.update(region_type=kind or "non_molecule", status=kept)
        elif action == "recognize":
            # Only a confirmed molecule can be sent to be read.
            if r["region_type"] != "molecule" or not r["confirmed"]:
                return False
            r.update(status="confirmed")
        elif action in ("confirm", "unconfirm"):
            yes = action == "confirm"
            r.update(status="confirmed" if yes else "edited", confirmed=yes, region_type=(yes and kind) or r["region_type"])
        elif action == "merge":
            o = self.state.get(other_id)
            if o is None or o is r or o["page"] != r["page"]:
                return False
            r.update(x1=min(r["x1"], o["x1"]), y1=min(r["y1"], o["y1"]), x2=max(r["x2"], o["x2"]), y2=max(r["y2"], o["y2"]), status="edited", confirmed=False)
            r["region_type"] = kind or (r["region_type"] if r["region_type"] == o["region_type"] else "unknown")
            o.update(status="deleted", confirmed=False)
            o["audit"].append("merged_into")
        elif action == "split":
            middle = (r["x1"] + r["x2"]) // 2
            if other_id in self.state or not r["x1"] < middle < r["x2"]:
                return False
            kind = kind or r["region_type"]
            self.state[other_id] = {**r, "region_id": other_id, "x1": middle, "status": "edited", "confirmed": False, "audit": ["split_from"], "region_type": kind}
            r.update(x2=middle, status="edited", confirmed=False, region_type=kind)
        else:
            return False
        return True

    def end(self):
        return [(*_PLAIN(r), ",".join(r["audit"])) for r in self.state.values()]


def apply_edits(regions: DataFrame, edits: DataFrame, width: int, height: int) -> DataFrame:
    """Regions after the edits of their document.

    ``regions``: document_id, page, region_id, x1, y1, x2, y2, region_type, status, confirmed. ``edits``: document_id, seq,
    action (add, update, delete, mark, confirm, unconfirm, recognize, merge, split, confirm_page), region_id, other_id, page,
    x1, y1, x2, y2, region_type. The result has ``audit``, the applied actions joined by commas; a failed one is followed by
    ``!``. A task reads a document's regions, then its edits, as a stream, and keeps its regions.
    """
    box = [F.col(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = regions.select("document_id", F.lit(False).alias("is_edit"), none("long", "seq"), none("string", "action"), "region_id", none("string", "other_id"), F.col("page").cast("int").alias("page"), *box, "region_type", "status", "confirmed")
    then = edits.select("document_id", F.lit(True).alias("is_edit"), F.col("seq").cast("long").alias("seq"), "action", "region_id", "other_id", F.col("page").cast("int").alias("page"), *box, "region_type", none("string", "status"), none("boolean", "confirmed"))
    schema = "document_id string, page int, region_id string, x1 int, y1 int, x2 int, y2 int, region_type string, status string, confirmed boolean, audit string"
    return fold(first.unionByName(then), "document_id", ["is_edit", "seq", "region_id"], lambda key: _Regions(key, width, height), schema)


def annotations(regions: DataFrame) -> DataFrame:
    """What a detector is trained on: confirmed, undeleted regions with a valid box, gathered by page; a page has few."""
    good = regions.where("status <> 'deleted' and confirmed and x2 > x1 and y2 > y1")
    return good.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("region_id", "x1", "y1", "x2", "y2", "region_type"))).alias("regions"))


def skipped(regions: DataFrame) -> DataFrame:
    """How many regions an export leaves out, by the first reason that holds."""
    reason = F.when(F.col("status") == "deleted", "deleted").when(~F.col("confirmed"), "unconfirmed").when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "bad_box").otherwise("")
    return regions.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def review_states(actions: DataFrame) -> DataFrame:
    """State of each item after its actions (item, seq, action, actor): the last one counts; each resubmission is a revision.

    No step of this log depends on an earlier one but through the last action and a count, so no fold is needed.
    """
    known = F.col("action").isin(*ACTIONS)
    table = F.create_map(*[F.lit(x) for k, (s, _) in ACTIONS.items() for x in (k, s)])
    trains = [k for k, (_, t) in ACTIONS.items() if t]
    by = actions.where(known & (F.col("actor") != "")).groupBy("item").agg(F.max_by(F.struct("action", "actor"), "seq").alias("last"), F.count(F.when(F.col("action") == "resubmit", 1)).alias("revision"), F.count("*").alias("n_actions"))
    reviewer = F.when(F.col("last.action") != "resubmit", F.col("last.actor"))
    return by.select("item", table[F.col("last.action")].alias("status"), F.col("last.action").isin(*trains).alias("include_in_training"), "revision", "n_actions", reviewer.alias("reviewer"))
