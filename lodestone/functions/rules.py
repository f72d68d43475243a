"""Rule ladders over text and numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import blank_metadata, codes, contains_any, ladder

#: Licences that allow redistribution.
ALLOWED_LICENSES = ("cc0-1.0", "cc-by-4.0", "cc-by-3.0", "cc-by-sa-4.0", "cc-by-sa-3.0", "public-domain-pubchem")
#: Words that leave a licence unclear.
UNCLEAR = ("no explicit", "unclear", "unknown", "not stated", "local research")
#: What says that an output could not be read.
UNPARSED = ("unparsable", "cannot parse", "could not parse", "invalid smiles", "无法解析")
#: Classes of failure messages, the first that matches counts.
FAILURES = (
    ("timeout", ("timeout", "timed out", "超时")),
    ("cuda_failure", ("cuda", "cudnn", "cublas", "gpu", "out of memory", "oom")),
    ("image_decode_failure", ("no such file", "cannot identify image", "decode", "truncated image")),
    ("input_preprocessing_failure", ("preprocess", "normalize", "unsupported image", "array dimensions")),
    ("dependency_failure", ("dependency", "modulenotfound", "importerror", "not installed")),
    ("subprocess_failure", ("subprocess", "child process", "return code", "worker", "子进程")),
    ("model_inference_failure", ("inference", "predict", "model", "推理")),
)


def failure_category(message: Column, given: Column | None = None, raw_output: Column | None = None, failed: Column | None = None) -> Column:
    """The class of a failure: one that is ``given`` and known, or what a raw output or the message says.

    A result that ``failed`` (all do where it is not given) and left a raw output, or says that it was not readable, could not
    be parsed; then the words of the message count.
    """
    text = F.lower(F.coalesce(message, F.lit("")))
    names = ("output_parse_failure", *(n for n, _ in FAILURES), "unknown_backend_failure")
    known = F.when(given.isin(*names), given) if given is not None else F.lit(None).cast("string")
    raw = F.coalesce(raw_output, F.lit("")) != "" if raw_output is not None else F.lit(False)
    unparsed = (failed if failed is not None else F.lit(True)) & (raw | contains_any(text, UNPARSED))
    return F.coalesce(known, ladder("unknown_backend_failure", (unparsed, "output_parse_failure"), *[(contains_any(text, words), name) for name, words in FAILURES]))


def rejection_target(expected: Column, markers: tuple[str, ...], *fields: Column) -> Column:
    """Whether a sample should be rejected: its expected action says so, or, where it says neither, a marker in one of its texts."""
    action = F.lower(F.coalesce(expected, F.lit("")))
    marked = F.array_contains(F.array(*[contains_any(F.lower(F.coalesce(f, F.lit(""))), markers) for f in fields]), True)
    return ladder(marked, (action == "reject", True), (action == "recognize", False))


#: A path in a line: a drive's letter if there is one, and two names or more, each after a separator, to the end of the word.
PATH = r"(?:(?<![A-Za-z])[A-Za-z]:)?[/\\]+[^\s/\\]+[/\\]+[^\s/\\]\S*"


def tidy_message(message: Column, limit: int = 500) -> Column:
    """One line with single spaces and ``<path>`` for each path, at most ``limit`` characters. Nulls and zero bytes are blanks."""
    line = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"[\s\x00]+", " "))
    return F.substring(F.regexp_replace(line, PATH, "<path>"), 1, limit)


#: How licence statements are written, on words and numbers with hyphens and single spaces between them, and the key of each; ``#`` stands for a
#: version, which the key takes over.
LICENSES = (
    ("cc ?(?:0|zero)", "cc0-1.0"),
    ("publicdomain zero #", "cc0-#"),
    ("(?:cc ?|licenses )by ?-? ?sa ?(?:version )?#", "cc-by-sa-#"),
    ("(?:cc ?|licenses )by ?(?:version )?#", "cc-by-#"),
)
_VERSION = r"([0-9](?:[.][0-9])?)(?![0-9]|[.][0-9])"


def license_key(value: Column) -> Column:
    """A short key of a licence statement; empty where it names no version or is unknown.

    A statement of the public domain that names PubChem comes first, then the rows of ``LICENSES`` in their order.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9.-]+", " "))
    forms = []
    for form, key in LICENSES:
        pattern = rf"(?<![a-z0-9]){form.replace('#', _VERSION)}(?![a-z])"
        parts = key.partition("#")
        made = F.concat(F.lit(parts[0]), F.regexp_extract(words, pattern, 1)) if parts[1] else F.lit(key)
        forms.append((F.rlike(words, F.lit(pattern)), made))
    named = [F.rlike(words, F.lit(rf"\b{w}\b")) for w in ("public", "domain", "pubchem")]
    return ladder("", (named[0] & named[1] & named[2], F.lit("public-domain-pubchem")), *forms)


def license_allowed(value: Column) -> Column:
    """Whether a licence statement, or its key, is on the list."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "\\s+", " "))
    return plain.isin(*ALLOWED_LICENSES) | license_key(value).isin(*ALLOWED_LICENSES)


def unclear_license(value: Column) -> Column:
    """Whether a licence statement is missing or says that it is unclear."""
    return blank_metadata(value) | contains_any(F.lower(F.trim(F.coalesce(value, F.lit("")))), UNCLEAR)


def complexity_group(heavy: Column, rings: Column) -> Column:
    """Small, medium or large by atom and ring counts."""
    heavy, rings = F.coalesce(heavy, F.lit(0)), F.coalesce(rings, F.lit(0))
    return ladder("medium_complexity", ((heavy <= 12) & (rings <= 1), "small_low_complexity"), ((heavy >= 35) | (rings >= 5), "large_high_complexity"))


def property_violations(c=F.col) -> Column:
    """Which of the five limits a compound breaks."""
    return codes(("molecular_weight", c("molecular_weight") > 500), ("logp", c("logp") > 5), ("hbd", c("hbd") > 5), ("hba", c("hba") > 10), ("rotatable_bonds", c("rotatable_bonds") > 10))


#: Why a wrong structure is wrong, in the order in which the reasons are looked at.
STRUCTURAL = ("backend_failure", "invalid_structure", "stereochemistry_error", "missing_fragment", "extra_fragment", "charge_error", "wrong_atom", "wrong_bond_order", "wrong_connectivity", "structural_mismatch_unclassified")


def structural_error(success, valid, same_canonical, same_isomeric, fragments, truth_fragments, same_charge, same_atoms, same_bonds, same_key) -> Column:
    """The first of ten outcomes that explains a wrong structure."""
    holds = (~success, ~valid, same_canonical & ~same_isomeric, fragments < truth_fragments, fragments > truth_fragments, ~same_charge, ~same_atoms, ~same_bonds, ~same_key)
    return ladder(STRUCTURAL[-1], *zip(holds, STRUCTURAL, strict=False))
