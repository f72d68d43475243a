"""Boxes on pages: overlap joins, one-to-one matching, merges, suppression, context and clamping.

Everything is keyed by page. Joins are equi-joins on the page with the overlap as a condition; the three folds whose steps
depend on earlier ones read the sorted rows of a page as a stream and keep what they have chosen so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import box_area, codes, count_if, ladder, overlap, rate0
from lodestone.operators.folds import fold


def _sides(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = lambda side, p: boxes.where(F.col("side") == side).select("page_id", F.col("box_id").alias(f"{p}id"), *[F.col(k).alias(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")])
    return named("truth", "t_"), named("proposal", "p_")


def pairs(boxes: DataFrame) -> DataFrame:
    """Overlapping pairs of true and proposed boxes of a page, with their shared area and the area of both."""
    truth, proposed = _sides(boxes)
    touch = (F.col("t_x1") < F.col("p_x2")) & (F.col("p_x1") < F.col("t_x2")) & (F.col("t_y1") < F.col("p_y2")) & (F.col("p_y1") < F.col("t_y2"))
    both = truth.join(proposed, "page_id").where(touch)
    return both.withColumn("shared", overlap("t_", "p_")).withColumn("union", box_area("t_") + box_area("p_") - F.col("shared")).withColumn("iou", F.bround(F.col("shared") / F.col("union"), 6))


class _Matches:
    """Both sides of a pair are free when it comes up, or it is passed over."""

    def __init__(self, page):
        self.page, self.truths, self.proposals = page, set(), set()

    def take(self, t, p, shared, union, iou):
        if t in self.truths or p in self.proposals:
            return ()
        self.truths.add(t)
        self.proposals.add(p)
        return ((self.page, t, p, iou),)

    def end(self):
        return ()


def match(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches of true and proposed boxes: the largest overlap first; ties prefer the larger ids."""
    enough = pairs(boxes).where(F.col("shared") / F.col("union") >= threshold).select("page_id", "t_id", "p_id", "shared", "union", "iou")
    return fold(enough, "page_id", [F.desc(F.col("shared") / F.col("union")), F.desc("t_id"), F.desc("p_id")], _Matches, "page_id long, t_id long, p_id long, iou double")


def unmatched(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, box_id, kind): true boxes that no match has are missed, such proposals are false."""
    used = matches.select("page_id", F.explode(F.array("t_id", "p_id")).alias("box_id"))
    kind = F.when(F.col("side") == "truth", "missed").otherwise("false")
    return boxes.join(used, ["page_id", "box_id"], "left_anti").select("page_id", "box_id", kind.alias("kind"))


def events(boxes: DataFrame, least: float = 0.1) -> DataFrame:
    """Of each page: proposals over two true boxes or more, true boxes over two proposals or more, by shares of the other's area."""
    both = pairs(boxes)
    over_truth = both.where(F.col("shared") / box_area("t_") >= least).groupBy("page_id", "p_id").agg(F.count("*").alias("n")).where("n >= 2").groupBy("page_id").agg(F.count("*").alias("merged"))
    over_proposal = both.where(F.col("shared") / box_area("p_") >= least).groupBy("page_id", "t_id").agg(F.count("*").alias("n")).where("n >= 2").groupBy("page_id").agg(F.count("*").alias("split"))
    pages = boxes.select("page_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.join(over_truth, "page_id", "left").join(over_proposal, "page_id", "left").select("page_id", zero("merged"), zero("split"))


def duplicates(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each page: how many accepted proposals hit a true box beyond the first."""
    accepted = boxes.where("side = 'truth' or decision = 'accept_molecule'")
    hits = pairs(accepted).where(F.col("shared") / F.col("union") >= threshold).groupBy("page_id", "t_id").agg(F.count("*").alias("n"))
    return hits.groupBy("page_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def proposal_totals(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of all pages together, with micro precision, recall and F1 and the mean overlap of matches in millionths."""
    sides = boxes.agg(count_if(F.col("side") == "truth").alias("n_truth"), count_if(F.col("side") == "proposal").alias("n_proposals"), F.count_distinct("page_id").alias("n_pages"))
    found = match(boxes, threshold).agg(F.count("*").alias("tp"), F.sum(F.bround(F.col("iou") * 1e6, 0).cast("long")).alias("millionths"))
    c = F.col
    return sides.crossJoin(found).select("n_pages", "n_truth", "n_proposals", "tp", rate0(c("tp"), c("n_proposals")).alias("precision"), rate0(c("tp"), c("n_truth")).alias("recall"), rate0(2 * c("tp"), c("n_truth") + c("n_proposals")).alias("f1"), F.bround(c("millionths") / c("tp"), 3).alias("mean_iou_millionths"))  # one row each


def routing(boxes: DataFrame, *by: str) -> DataFrame:
    """Proposals accepted, sent to review and rejected, of all pages or by ``by``."""
    p, c = F.col("side") == "proposal", F.col
    return boxes.groupBy(*by).agg(count_if(c("side") == "truth").alias("n_truth"), count_if(p).alias("n_proposals"), count_if(p & (c("decision") == "accept_molecule")).alias("n_accepted"), count_if(p & (c("decision") == "review_needed")).alias("n_review"), count_if(p & (c("decision") == "reject_negative")).alias("n_rejected"))


class _Grid:
    """Boxes by place: a box lies in the cells that it touches of a grid about as coarse as the box is large, four at most."""

    def __init__(self):
        self.levels = {}

    @staticmethod
    def _touched(box, level: int) -> tuple[int, int, int, int]:
        side = 1 << level
        return int(box[0] // side), int(box[1] // side), int(box[2] // side), int(box[3] // side)

    def _cells(self, box) -> tuple[int, list[tuple[int, int]]]:
        level = int(max(box[2] - box[0], box[3] - box[1], 0)).bit_length()
        i, j, k, m = self._touched(box, level)
        return level, [(x, y) for x in range(i, k + 1) for y in range(j, m + 1)]

    def add(self, name: int, box) -> None:
        level, cells = self._cells(box)
        grid = self.levels.setdefault(level, {})
        for c in cells:
            grid.setdefault(c, {})[name] = box

    def remove(self, name: int, box) -> None:
        level, cells = self._cells(box)
        grid = self.levels[level]
        for c in cells:
            del grid[c][name]
            if not grid[c]:
                del grid[c]
        if not grid:
            del self.levels[level]

    def near(self, box) -> dict:
        """All boxes that may overlap a box, by name."""
        found = {}
        for level, grid in self.levels.items():
            i, j, k, m = self._touched(box, level)
            if (k - i + 1) * (m - j + 1) > len(grid):
                for (x, y), held in grid.items():
                    if i <= x <= k and j <= y <= m:
                        found.update(held)
            else:
                for x in range(i, k + 1):
                    for y in range(j, m + 1):
                        found.update(grid.get((x, y), ()))
        return found


def _positive(threshold: float) -> None:
    if threshold <= 0:
        raise ValueError("the threshold of overlap must be over 0")


class _Uncovered:
    """True boxes are chosen; a proposal is chosen unless a chosen box covers it."""

    def __init__(self, page, threshold: float):
        self.page, self.threshold, self.chosen, self.n = page, threshold, _Grid(), 0

    def take(self, box_id, side, x1, y1, x2, y2):
        box = (x1, y1, x2, y2)
        if side != "truth" and any(_smaller(box, o) >= self.threshold for o in self.chosen.near(box).values()):
            return ()
        self.n += 1
        self.chosen.add(self.n, box)
        return ((self.page, box_id, side),)

    def end(self):
        return ()


def suppress(boxes: DataFrame, threshold: float = 0.68) -> DataFrame:
    """True boxes of a page, then proposals in reading order that no box chosen so far covers: share of the smaller area.

    A box is compared with those near it only, by a grid over the page; the threshold is over 0.
    """
    _positive(threshold)
    rows = boxes.select("page_id", "box_id", "side", "x1", "y1", "x2", "y2")
    return fold(rows, "page_id", [F.col("side") != "truth", "y1", "x1", "box_id"], lambda page: _Uncovered(page, threshold), "page_id long, box_id long, side string")


def _smaller(a, b) -> float:
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return shared / min(max((a[2] - a[0]) * (a[3] - a[1]), 1), max((b[2] - b[0]) * (b[3] - b[1]), 1))


#: Up to so many regions a page has a list, beyond it a grid.
FEW = 64


class _Regions:
    """Regions of a page; a box that covers some, or is covered, becomes one with them and may then reach others."""

    def __init__(self, page, threshold: float):
        self.page, self.threshold, self.regions, self.places, self.n = page, threshold, {}, None, 0

    def near(self, box) -> list:
        if self.places is not None:
            return list(self.places.near(box).items())
        x1, y1, x2, y2 = box
        return [(k, o) for k, o in self.regions.items() if o[0] < x2 and x1 < o[2] and o[1] < y2 and y1 < o[3]]

    def take(self, box_id, *box):
        while hit := [(k, o) for k, o in self.near(box) if _smaller(box, o) >= self.threshold]:
            for k, o in hit:
                del self.regions[k]
                if self.places is not None:
                    self.places.remove(k, o)
                box = (min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3]))
        self.n += 1
        self.regions[self.n] = box
        if self.places is not None:
            self.places.add(self.n, box)
        elif len(self.regions) > FEW:
            self.places = _Grid()
            for k, o in self.regions.items():
                self.places.add(k, o)
        return ()

    def end(self):
        return [(self.page, k, *b) for k, b in enumerate(sorted(self.regions.values(), key=lambda b: (b[1], b[0], b[3], b[2])), 1)]


def merge(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes of a page grown over the boxes they cover, until nothing changes: (page_id, region, x1, y1, x2, y2).

    A box is compared with the regions near it only, by a grid over the page; the threshold is over 0.
    """
    _positive(threshold)
    rows = boxes.select("page_id", "box_id", "x1", "y1", "x2", "y2")
    return fold(rows, "page_id", ["y1", "x1", "box_id"], lambda page: _Regions(page, threshold), "page_id long, region long, x1 long, y1 long, x2 long, y2 long")


def context(boxes: DataFrame, least: int = 350_000) -> DataFrame:
    """Of each proposal, in millionths: the share that true boxes cover (added up, at most all), the best overlap, and the box that holds most of it."""
    _, proposed = _sides(boxes)
    part = lambda of: F.call_function("div", F.col("shared") * 1_000_000, of)
    near = pairs(boxes).withColumns({"covered": part(box_area("p_")), "best": part(F.least(box_area("t_"), box_area("p_")))})
    found = near.groupBy("page_id", "p_id").agg(
        F.least(F.lit(1_000_000), F.sum(F.when(F.col("best") >= least, F.col("covered")))).alias("coverage"), F.max("best").alias("best_overlap"), F.max_by("t_id", F.struct("covered", "t_id")).alias("container")
    )
    zero = F.lit(0).cast("long")
    return proposed.select("page_id", "p_id").join(found, ["page_id", "p_id"], "left").select("page_id", "p_id", F.coalesce("coverage", zero).alias("coverage"), F.coalesce("best_overlap", zero).alias("best_overlap"), "container")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes numbered page by page from top to bottom and left to right."""
    order = Window.partitionBy("page_id").orderBy("y1", "x1", "side", "box_id")
    return boxes.select("page_id", "box_id", F.row_number().over(order).alias("n")).withColumn("region_id", F.format_string("p%d_r%03d", "page_id", "n")).drop("n")


def clamp(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes held to a page, with an error code where nothing is left or something was cut."""
    cut = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > width) | (F.col("y2") > height)
    held = boxes.withColumn("cut", cut).withColumns({k: F.least(F.greatest(F.col(k), F.lit(0)), F.lit(width if k[0] == "x" else height)) for k in ("x1", "x2", "y1", "y2")})
    return held.select("page_id", "box_id", "x1", "y1", "x2", "y2", ladder("", ((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "empty_box"), (F.col("cut"), "outside_page")).alias("error"))


def risks(boxes: DataFrame, page_size: int = 400) -> DataFrame:
    """Codes of what is odd about each box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.select("page_id", "box_id", F.array_join(codes(("small", w * h < 6400), ("outside", (F.col("x2") > page_size) | (F.col("y2") > page_size)), ("at_edge", (F.col("x1") == 0) | (F.col("y1") == 0))), ",").alias("codes"))
