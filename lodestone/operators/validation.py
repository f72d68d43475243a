"""Checks of whole datasets as rows of (code, key): trusted manifests with their files and sources, and sets of input files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import codes, contains_any, count_if, ladder
from lodestone.operators.splits import leakage

#: The images that each compound has.
VARIANTS = ("official_clean", "rendered_clean", "synthetic_perturbation")


def _coded(rows: DataFrame, key: str, *pairs: tuple[str, Column]) -> DataFrame:
    return rows.select(F.explode(codes(*[(k, F.coalesce(c, F.lit(True))) for k, c in pairs])).alias("code"), F.col(key).cast("string").alias("key"))


def trusted_errors(manifest: DataFrame, sources: DataFrame, files: DataFrame, checksums: DataFrame) -> DataFrame:
    """(code, key) of all that is wrong with a trusted dataset; no rows if nothing is.

    ``manifest``: sample_id, compound, image_path, image_sha256, origin, review_status, variant, seed, split, inchikey,
    canonical_key, scaffold_key. ``sources``: compound, property_url, image_url, origin, source_license, metadata_compound,
    and the stored and recorded digests property_sha256, metadata_property_sha256, image_sha256, metadata_image_sha256.
    ``files``: path, sha256. ``checksums``: path, sha256 as frozen. A comparison with a missing value is an error.
    """
    c = F.col
    listed = checksums.select("path", c("sha256").alias("frozen")).join(files.select("path", c("sha256").alias("found")), "path", "left")
    frozen = _coded(listed, "path", ("checksum_missing", c("found").isNull()), ("checksum_mismatch", c("found").isNotNull() & (c("found") != c("frozen"))))

    escaped = F.coalesce(c("image_path"), F.lit("")).rlike("(^|/)[.][.](/|$)") | F.startswith(c("image_path"), F.lit("/"))
    at = manifest.join(files.select(c("path").alias("image_path"), c("sha256").alias("found")), "image_path", "left")
    missing = c("found").isNull() | F.coalesce(escaped, F.lit(True))
    images = _coded(
        at, "sample_id",
        ("image_missing_or_escaped", missing), ("image_hash_mismatch", ~missing & ~c("found").eqNullSafe(c("image_sha256"))),
        ("untrusted_ground_truth", (c("origin") != "pubchem") | (c("review_status") != "source_verified")),
        ("untraceable_perturbation", (c("variant") == VARIANTS[2]) & F.coalesce(c("seed") <= 0, F.lit(True))),
    )

    by = manifest.groupBy("compound").agg(F.array_sort(F.collect_set("variant")).alias("variants"), F.count_distinct("split").alias("splits"), F.count_distinct("inchikey", "canonical_key").alias("identities"))
    wanted = F.array(*map(F.lit, sorted(VARIANTS)))
    groups = _coded(by, "compound", ("variant_set_mismatch", c("variants") != wanted), ("cid_split_leakage", c("splits") != 1), ("cid_identity_inconsistent", c("identities") != 1))

    own = by.select("compound").join(sources.withColumn("there", F.lit(True)), "compound", "left")
    there, name = c("there").isNotNull(), c("compound").cast("string")
    listed_in = F.array_contains(F.split(F.substring_index(F.substring_index("property_url", "/cid/", -1), "/", 1), ","), name)
    provenance = _coded(
        own, "compound",
        ("missing_source_record", ~there),
        ("source_cid_url_mismatch", there & ~(F.coalesce(F.contains("property_url", F.lit("/cid/")) & listed_in, F.lit(False)) & F.coalesce(F.contains("image_url", F.concat(F.lit("/cid/"), name, F.lit("/"))), F.lit(False)))),
        ("source_provenance_missing", there & ((F.coalesce(c("origin"), F.lit("")) != "pubchem") | (F.coalesce(c("source_license"), F.lit("")) == ""))),
        ("metadata_cid_mismatch", there & ~c("metadata_compound").eqNullSafe(c("compound"))),
        ("property_response_hash_mismatch", there & ~c("metadata_property_sha256").eqNullSafe(c("property_sha256"))),
        ("image_response_hash_mismatch", there & ~c("metadata_image_sha256").eqNullSafe(c("image_sha256"))),
    )
    leaks = leakage(manifest, "split", "inchikey", "canonical_key", "scaffold_key", ignore=("",)).select(F.concat("key", F.lit("_split_leakage")).alias("code"), F.col("value").alias("key"))

    made = frozen.unionByName(images).unionByName(groups).unionByName(provenance).unionByName(leaks)
    for k in ("inchikey", "canonical_key"):
        shared = manifest.where(c(k) != "").groupBy(k).agg(F.count_distinct("compound").alias("n")).where("n > 1")
        made = made.unionByName(shared.select(F.lit(f"duplicate_{k}_across_cids").alias("code"), c(k).alias("key")))
    return made.distinct()


#: Fields that a row that should be rejected may leave empty.
TRUTH_FIELDS = ("ground_truth_smiles", "ground_truth_inchikey")


def manifest_errors(manifest: DataFrame, files: DataFrame, required: tuple[str, ...], real: tuple[str, ...] = ()) -> DataFrame:
    """(line, code) of what is wrong with the rows of a manifest, as texts with their ``line``; a code may name its field.

    ``required`` must not be empty; with ``real``, nor may these, and rows must be verified, by name of annotator and reviewer. A
    sample's number may come once: later lines are in error. ``files``: path, sha256 of what is there.
    """
    c = F.col
    text = lambda k: F.trim(F.coalesce(c(k), F.lit(""))) if k in manifest.columns else F.lit("")
    action = F.lower(text("expected_action"))
    action = F.when(action == "", "recognize").otherwise(action)
    known = action.isin("recognize", "reject")
    excused = lambda k: (action == "reject") if k in TRUTH_FIELDS else F.lit(False)
    firsts = manifest.where(text("sample_id") != "").groupBy(text("sample_id").alias("own_id")).agg(F.min("line").alias("first_line"))
    rows = manifest.withColumn("own_id", text("sample_id")).join(firsts, "own_id", "left").withColumn("own_path", text("image_path")).join(files.select(c("path").alias("own_path"), F.lower("sha256").alias("found")), "own_path", "left")
    path, escaped = c("own_path"), c("own_path").rlike("(^|/)[.][.](/|$)") | F.startswith(c("own_path"), F.lit("/"))
    found = [(f"empty:{k}", (text(k) == "") & ~excused(k)) for k in required if k != "notes"]
    found += [
        ("duplicate_sample_id", F.coalesce(c("line") > c("first_line"), F.lit(False))), ("image_path_escapes", (path != "") & escaped), ("image_missing", (path != "") & ~escaped & c("found").isNull()),
        ("image_sha256_mismatch", (path != "") & ~escaped & F.coalesce((text("image_sha256") != "") & (F.lower(text("image_sha256")) != c("found")), F.lit(False))), ("bad_expected_action", ~known),
    ]
    if real:
        verified = text("review_status") == "verified"
        found += [(f"real_empty:{k}", (text(k) == "") & ~excused(k)) for k in real]
        found += [("not_verified", ~verified), *((f"verified_without:{k}", verified & (text(k) == "")) for k in ("annotator", "reviewer"))]
    return rows.select("line", F.explode(codes(*found)).alias("code"))


def input_set(entries: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """One row about a set of input files (name, position, sha256, size, valid, message): totals, duplicates and error codes.

    Of valid files with one digest the first counts, the others are duplicates.
    """
    valid = F.col("valid") & (F.col("sha256") != "")
    groups = entries.where(valid).groupBy("sha256").agg(F.count("*").alias("n"))
    again = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_files"))  # one row
    total = entries.agg(F.count("*").alias("total_files"), count_if(F.col("valid")).alias("valid_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.array_sort(F.collect_set(F.when(~F.col("valid"), F.nullif("message", F.lit(""))))).alias("messages"))
    limits = codes(("too_many_files", F.col("total_files") > most_files), ("too_many_bytes", F.col("total_bytes") > most_bytes))
    return total.crossJoin(again).select("total_files", "valid_files", "duplicate_files", "total_bytes", F.concat(limits, "messages").alias("errors"))  # one row each


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """(name, duplicate_of): valid files whose digest an earlier valid file has, with that file's name."""
    valid = entries.where(F.col("valid") & (F.col("sha256") != ""))
    firsts = valid.groupBy("sha256").agg(F.min(F.struct("position", "name")).alias("first"))
    return valid.join(firsts, "sha256").where(F.col("position") > F.col("first.position")).select("name", F.col("first.name").alias("duplicate_of"))


#: Fields that a labelled sample must have.
SAMPLE_FIELDS = ("sample_id", "source_document", "source_url", "source_license", "attribution", "category", "expected_action", "review_status")
#: Categories of crops that show no single molecule.
NEGATIVE = ("reaction", "multiple_molecules", "text", "table", "figure", "logo", "blank", "invalid_crop")


def row_findings(rows: DataFrame, least_quality: float = 0.55, negative: tuple[str, ...] = NEGATIVE) -> DataFrame:
    """(sample_id, errors, risks): what is certainly wrong with each labelled sample, and what asks for a look; arrays of codes in a fixed order.

    Reads the fields of a sample; ``image_sha256`` and ``perceptual_hash`` as given and as found (``found_sha256``, ``found_phash``);
    ``bbox`` (array of whole numbers, or null) with ``page_width`` and ``page_height``; ``edge_ink`` and ``quality``; ``reference_smiles`` and
    ``reference_inchikey`` as given, ``reference_valid`` and ``source_inchikey`` of the structure read from them; and ``backends``, an array of
    (backend, valid, key) in the order of preference, whose first two must agree. A missing value is found nowhere else than
    in its own code: what can't be compared has no mismatch.
    """
    c, text = F.col, lambda k: F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))
    differ = lambda a, b: (text(a) != "") & (text(b) != "") & (text(a) != text(b))
    x1, y1, x2, y2 = (F.get("bbox", F.lit(k)) for k in range(4))
    boxed = F.coalesce(F.size("bbox") > 0, F.lit(False))
    shaped = boxed & (F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull())
    empty = shaped & ((F.least(x1, y1) < 0) | (x2 <= x1) | (y2 <= y1))
    beyond = shaped & ~empty & F.coalesce((c("page_width") > 0) & (c("page_height") > 0) & ((x2 > c("page_width")) | (y2 > c("page_height"))), F.lit(False))
    category = F.lower(text("category"))
    kind = F.when(category.isin("molecule", *negative), category).otherwise("invalid_crop")
    named = F.when(category == "", "invalid_crop").otherwise(category)
    valid = F.filter("backends", lambda b: b["valid"])
    first, second = F.get("backends", F.lit(0)), F.get("backends", F.lit(1))
    agree = F.coalesce(first["valid"] & second["valid"] & (first["key"] == second["key"]), F.lit(False))
    errors = codes(
        *[(f"missing_{k}", text(k) == "") for k in SAMPLE_FIELDS], ("image_sha256_mismatch", differ("image_sha256", "found_sha256")),
        ("invalid_bbox", boxed & ~shaped), ("bbox_out_of_bounds_or_empty", empty), ("bbox_out_of_bounds", beyond), ("invalid_category", (kind == "invalid_crop") & (named != "invalid_crop")),
        ("invalid_reference_smiles", (text("reference_smiles") != "") & ~F.coalesce("reference_valid", F.lit(False))), ("source_inchikey_mismatch", differ("reference_inchikey", "source_inchikey")),
    )
    faulty_box = (boxed & ~shaped) | empty | beyond
    risks = codes(
        ("perceptual_hash_mismatch", differ("perceptual_hash", "found_phash")), ("bbox_touches_structure_edge", ~faulty_box & F.coalesce("edge_ink", F.lit(False))),
        ("model_disagreement", (kind == "molecule") & ~agree), ("only_one_valid_model", (kind == "molecule") & (F.size(valid) == 1)),
        ("negative_sample_has_valid_smiles", kind.isin(*negative) & (F.size(valid) > 0)), ("low_image_quality", F.coalesce("quality", F.lit(0.0)) < least_quality),
    )
    return rows.select("sample_id", errors.alias("errors"), risks.alias("risks"))


#: What a feature that gives the truth away has in its name.
TELLTALE = ("ground_truth", "truth", "target", "label", "expected", "test_correct", "inchikey_exact", "canonical_exact", "formula_match")


def feature_finding(name: Column, allowed: tuple[str, ...], telltale: tuple[str, ...] = TELLTALE) -> Column:
    """What is wrong with a feature's name: it may not be read (``forbidden``), or is not known (``unsupported``); null if nothing is."""
    return ladder(None, (contains_any(F.lower(F.trim(name)), telltale), "forbidden"), (~name.isin(*allowed), "unsupported"))


def feature_findings(rows: DataFrame, features: str, allowed: tuple[str, ...]) -> DataFrame:
    """(feature, finding, n): the features that a router must not be given, and those that it lacks, with the number of rows.

    ``features`` is a map column of a row's features by name. A row without an allowed feature counts for it as ``missing``; a null map
    lacks all.
    """
    names = F.coalesce(F.map_keys(features), F.array().cast("array<string>"))
    given = F.transform(names, lambda k: F.struct(k.alias("feature"), feature_finding(k, allowed).alias("finding")))
    absent = F.transform(F.array_except(F.array(*map(F.lit, allowed)), names), lambda k: F.struct(k.alias("feature"), F.lit("missing").alias("finding")))
    found = rows.select(F.explode(F.concat(F.filter(given, lambda x: x["finding"].isNotNull()), absent)).alias("x"))
    return found.groupBy("x.feature", "x.finding").agg(F.count("*").alias("n"))


def guarded_features(df: DataFrame, allowed: tuple[str, ...], telltale: tuple[str, ...] = TELLTALE) -> DataFrame:
    """``df`` with exactly the allowed features as columns; an error names the forbidden, else the unsupported, else the missing ones."""
    told = [c for c in df.columns if any(t in c.strip().lower() for t in telltale)]
    for what, names in (("must not be read", told), ("are not supported", set(df.columns) - set(allowed)), ("are missing", set(allowed) - set(df.columns))):
        if names:
            raise ValueError(f"features {what}: {', '.join(sorted(names))}")
    return df.select(*allowed)


def holdout_findings(held: DataFrame, reference: DataFrame, sources: DataFrame, keys: tuple[str, ...], identity: str, types: tuple[str, ...], *, role: str = "external_holdout", least: int = 300) -> DataFrame:
    """(code, n): what speaks against a held-out set, each code with how often; no row if nothing does.

    - ``<key>_leakage``: values of each of ``keys`` that the reference set has too;
    - ``wrong_split``: rows whose split is not ``role``;
    - ``untyped_perturbation``: perturbed rows whose perturbation is none of ``types``; ``type_missing``: types that no row has;
    - ``not_byte_exact``: official rows whose checksum is not that of their source, or that have no source;
    - ``too_few_identities``: how many identities are missing to ``least``.

    Rows are perturbed or official by ``image_variant``; ``sources`` has ``identity`` once and ``response_sha256``. Missing
    values of keys are no leak; missing checksums are not exact.
    """
    c = F.col
    found = []
    for k in keys:
        shared = held.select(k).where(c(k).isNotNull()).distinct().join(reference.select(k).distinct(), k, "left_semi")
        found.append(shared.agg(F.count("*").alias("n")).select(F.lit(f"{k}_leakage").alias("code"), "n"))
    perturbed = c("image_variant") == "synthetic_perturbation"
    typed = F.coalesce(c("perturbation").isin(*types), F.lit(False))
    has = [F.max(F.when(perturbed & (c("perturbation") == t), 1)).isNull().cast("long") for t in types]
    counts = {
        "wrong_split": count_if(~c("split").eqNullSafe(role)), "untyped_perturbation": count_if(perturbed & ~typed),
        "type_missing": sum(has[1:], has[0]), "too_few_identities": F.greatest(F.lit(0), least - F.count_distinct(identity)).cast("long"),
    }
    one = held.agg(*[v.alias(k) for k, v in counts.items()])
    found.append(one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("code"), c(k).alias("n")) for k in counts])).alias("x")).select("x.*"))
    official = held.where("image_variant = 'official_clean'").join(sources.select(identity, "response_sha256"), identity, "left")
    found.append(official.where(~F.coalesce(c("image_sha256") == c("response_sha256"), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("not_byte_exact").alias("code"), "n"))
    return reduce(DataFrame.unionByName, found).where("n > 0")
