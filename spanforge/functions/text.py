"""String expressions: headers, families, keys, sequence cleaning, null tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header and suffix patterns, the residue alphabet, the tokens a
# text reader treats as missing, and the header words of a code list.
FULLNAME_PATTERN = r"^ID=([^\s]+)\s+AC=([^\s]+)\s+OXX=([^\s]+)\s*$"
ALIGN_SUFFIX_PATTERN = r"OXX=[^\s,]*(?:,[^\s,]*)*_(\d+)_(\d+)"
NON_RESIDUE_PATTERN = "[^ACDEFGHIKLMNPQRSTVWYBZXUO]"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CODE_HEADER_WORDS = ("sequence name", "codename", "code_name")
WHITE_SPACE = " \t\n\x0b\f\r"


def null_tokens_to_null(c: Column) -> Column:
    """The reader's missing-value tokens as null, other text unchanged."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def clean_text(c: Column) -> Column:
    """Trimmed text; null, blank and any-case ``nan`` become the empty string."""
    text = strip(c.cast("string"))
    return F.coalesce(F.when(F.lower(text) != "nan", text), F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks alone. No pattern: it would be tried at every character."""
    return F.trim(c, F.lit(WHITE_SPACE))


def numeric(c: Column) -> Column:
    """Numeric text as double; anything else, NaN included, is null. Spark would
    otherwise rank NaN above every number in comparisons and maxima."""
    return F.nanvl(strip(c.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def first_numeric(columns: Sequence[str]) -> Column:
    """Left-to-right first numeric value among the columns."""
    return F.coalesce(*[numeric(F.col(c)) for c in columns])


def fullname_part(fullname: Column, group: int) -> Column:
    """1 = id, 2 = accession, 3 = OXX of a strict header; null if it does not parse."""
    text = strip(fullname)
    return F.when(text.rlike(FULLNAME_PATTERN), F.regexp_extract(text, FULLNAME_PATTERN, group))


def family_of(oxx: Column) -> Column:
    """Last non-empty comma token; null when there is none."""
    tokens = F.filter(F.transform(F.split(oxx, ","), strip), lambda t: t != "")
    return F.when(F.size(tokens) > 0, F.element_at(tokens, -1))


def align_suffix(fullname: Column, group: int) -> Column:
    """1 = start, 2 = stop of an ``OXX=..._start_stop`` suffix, null if absent."""
    return F.regexp_extract(fullname, ALIGN_SUFFIX_PATTERN, group).try_cast("bigint")


def strip_align_suffix(fullname: Column) -> Column:
    """Cut every comma part of the OXX value at its first underscore."""
    oxx = F.regexp_extract(fullname, r"\bOXX=([^\s]+)", 1)
    kept = F.array_join(F.transform(F.split(oxx, ","), lambda part: F.substring_index(part, "_", 1)), ",")
    return F.when(oxx == "", fullname).otherwise(F.replace(fullname, F.concat(F.lit("OXX="), oxx),
                                                           F.concat(F.lit("OXX="), kept)))


def first_token(header: Column) -> Column:
    return F.split(strip(header), r"\s+")[0]


def accession_of(header: Column) -> Column:
    """``tr|X|..`` and ``sp|X|..`` give X, any other header its first token."""
    token = first_token(header)
    parts = F.split(token, r"\|")
    named = (token.startswith("tr|") | token.startswith("sp|")) & (F.size(parts) >= 2)
    inner = strip(F.get(parts, F.lit(1)))
    return F.when(named & (inner != ""), inner).otherwise(token)


def prediction_id(header: Column) -> Column:
    """Id of a strict header, else the first token."""
    return F.coalesce(fullname_part(header, 1), first_token(header))


def build_fullname(protein_id: Column, group: Column) -> Column:
    return F.concat(F.lit("ID="), protein_id, F.lit(" AC="), protein_id, F.lit(" OXX=0,0,0,"), group.cast("string"))


def build_fullname_oxx(protein_id: Column, oxx: Column) -> Column:
    return F.concat(F.lit("ID="), protein_id, F.lit(" AC="), protein_id, F.lit(" OXX="), oxx)


def normalize_family(c: Column) -> Column:
    """Trimmed family text: nan -> empty, ``12.0`` -> ``12``."""
    return F.regexp_replace(clean_text(c), r"^(\d+)\.0$", "$1")


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def build_key(protein_id: Column, family: Column, delimiter: str = "-") -> Column:
    """``id-family``, or the id alone without a family; a non-numeric family fails the job."""
    if delimiter == "":
        raise ValueError("delimiter must not be empty for id-family keys")
    pid, fam = strip(protein_id.cast("string")), strip(family.cast("string"))
    bad = F.raise_error(F.concat(F.lit("family must be numeric: "), fam)).cast("string")
    return (
        F.when(fam.isNull() | (fam == ""), pid)
        .when(is_digits(fam), F.concat(pid, F.lit(delimiter), fam))
        .otherwise(bad)
    )


def parse_key(key: Column, delimiter: str = "-") -> Column:
    """``struct(id, family, scheme)``, split at the last delimiter before an all-digit tail."""
    mark = "".join("\\" + ch for ch in delimiter)
    pattern = rf"^(.+){mark}(\d+)$"
    match = F.lit(False) if delimiter == "" else key.rlike(pattern)
    return F.struct(
        F.when(match, F.regexp_extract(key, pattern, 1)).otherwise(key).alias("id"),
        F.when(match, F.regexp_extract(key, pattern, 2)).alias("family"),
        F.when(match, "id-family").otherwise("id").alias("scheme"),
    )


def clean_sequence(seq: Column) -> Column:
    """Upper-case residues of the fixed alphabet; everything else is dropped."""
    return F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), NON_RESIDUE_PATTERN, "")


def metric_token(c: Column) -> Column:
    """Lower-case letters and digits only, for permissive metric-name matching."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def set_name(index: Column) -> Column:
    return F.format_string("set_%02d", index)


def parse_list(raw: Column, kind: str, name: str = "list") -> Column:
    """Comma list as array<kind>; empty or unparsable input fails the job."""
    tokens = F.filter(F.transform(F.split(raw, ","), strip), lambda t: t != "")
    pattern = r"^[+-]?\d+$" if kind in ("int", "bigint") else None

    def convert(t: Column) -> Column:
        value = t.try_cast(kind)
        value = F.when(t.rlike(pattern), value) if pattern else value
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{name}: not a number: "), t)).cast(kind))

    return F.when(F.size(tokens) == 0, F.raise_error(F.lit(f"{name} cannot be empty")).cast(f"array<{kind}>")).otherwise(
        F.transform(tokens, convert)
    )


def optional_int(c: Column) -> Column:
    return c.try_cast("bigint")


def resolve_path(path: Column, folder: Column) -> Column:
    """Absolute paths unchanged, relative ones joined to the manifest's folder."""
    absolute = path.startswith("/") | path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/")
    return F.when(absolute, path).otherwise(F.concat_ws("/", folder, path))


def length_feature(vector: Column, length: Column, mode: str = "none") -> Column:
    """Append nothing, the sequence length or its inverse to an embedding vector."""
    mode = str(mode or "none").strip().lower()
    if mode == "none":
        return vector
    if mode not in ("raw", "inverse"):
        raise ValueError(f"length feature must be none, raw or inverse, not {mode!r}")
    size = F.when(length > 0, length.cast("double")).otherwise(
        F.raise_error(F.lit("length must be > 0 when appending a length feature")).cast("double")
    )
    value = size if mode == "raw" else 1.0 / size
    return F.concat(vector.cast("array<double>"), F.array(value))


def mask_from_flags(flags: Column) -> Column:
    """Ordered 0/1 flags as a mask string."""
    return F.array_join(F.transform(flags, lambda b: F.when(b.cast("int") == 1, "1").otherwise("0")), "")


def ones_between(mask: Column, start: Column, stop: Column) -> Column:
    """Count of ``1`` in the half-open slice of a mask string."""
    window = F.substring(mask, start.cast("int") + 1, (stop - start).cast("int"))
    return F.length(F.replace(window, F.lit("0"), F.lit(""))).cast("bigint")


def is_binary_mask(mask: Column) -> Column:
    return mask.rlike("^[01]*$")


def pad_right(values: Column, size: int, zero: Column) -> Column:
    """Fill an array with ``zero`` up to ``size`` entries."""
    return F.concat(values, F.array_repeat(zero, F.greatest(F.lit(size) - F.size(values), F.lit(0)).cast("int")))
