"""Column functions on peptide strings, tokens and token indices."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.constants import EOS, PAD, RESIDUE_MASSES, RESIDUE_REMAPPING, SPECIAL_TOKENS, TOKEN_PATTERN

STRINGS = "array<string>"


def map_of(values: Mapping) -> Column:
    """A map literal; for dictionaries of fixed, small size."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def vocabulary(residues: Iterable[str] = tuple(RESIDUE_MASSES)) -> list[str]:
    """The special tokens, then the residues, in order of their indices."""
    return [*SPECIAL_TOKENS, *residues]


def tokenize(peptide: Column) -> Column:
    """Residues with their modifications and standalone modifications; other characters are skipped, null gives none."""
    return F.coalesce(F.regexp_extract_all(peptide, F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast(STRINGS))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def to_proforma(tokens: Column) -> Column:
    """Tokens as one string, with a dash after a leading modification; null gives the empty string."""
    head = F.get(tokens, 0)
    marked = F.concat(head, F.lit("-"), F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), ""))
    leading = (F.size(tokens) > 1) & ~head.rlike("^[A-Za-z]")
    return F.coalesce(F.when(leading, marked).otherwise(F.array_join(tokens, "")), F.lit(""))


def tokens_listed(tokens: Column) -> Column:
    return F.array_join(tokens, ", ")


def sanitise(peptide: Column) -> Column:
    """The peptide without one pair of wrapping underscores and then one pair of wrapping dots."""
    return F.regexp_replace(F.regexp_replace(peptide, r"^_(.*)_$", "$1"), r"^\.(.*)\.$", "$1")


def remove_modifications(peptide: Column, equate_il: bool = True) -> Column:
    """Capital letters alone, without those of UNIMOD; I counts as L if asked for."""
    bare = F.regexp_replace(F.replace(peptide, F.lit("UNIMOD"), F.lit("")), "[^A-Z]", "")
    return F.translate(bare, "I", "L") if equate_il else bare


def normalised(peptide: Column) -> Column:
    """Capital letters alone, I as L before modifications go: UNIMOD names are then cut as they read with L."""
    return F.regexp_replace(F.replace(F.translate(peptide, "I", "L"), F.lit("UNLMOD"), F.lit("")), "[^A-Z]", "")


def upgraded(table: Mapping[str, float], names: Mapping[str, str] = RESIDUE_REMAPPING) -> dict[str, float]:
    """A residue table of an old model under the present names; residues that have no other name keep theirs."""
    return {names.get(token, token): mass for token, mass in table.items()}


def in_vocabulary(token: Column, vocab: list[str]) -> Column:
    """Whether a token is a residue of the vocabulary; special tokens count."""
    return token.isin(vocab)


def remap(tokens: Column, mapping: Mapping[str, str]) -> Column:
    """Tokens under their other names where the mapping has one."""
    names = map_of(mapping)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t))


def clean_tokens(tokens: Column, known: Iterable[str]) -> Column:
    """Tokens joined by comma and blank, unknown ones as padding; null gives the empty string."""
    names = list(known)
    return F.coalesce(F.array_join(F.transform(tokens, lambda t: F.when(t.isin(names), t).otherwise(F.lit(PAD))), ", "), F.lit(""))


def scan_number(label: Column, ordinal: Column) -> Column:
    """A number as it is, the number after "scan=", or else the ordinal."""
    digits = F.when(label.rlike(r"^\d+$"), label.try_cast("bigint"))
    after = F.regexp_extract(label, r"scan=(\d+)", 1).try_cast("bigint")
    return F.coalesce(digits, after, ordinal.cast("bigint"))


def accession(proteins: Column) -> Column:
    """The second field between bars of the first protein before a semicolon; null without one."""
    return F.get(F.split(F.get(F.split(proteins, ";"), 0), r"\|"), 1)


def modifications(peptide: Column) -> Column:
    return F.regexp_extract_all(peptide, F.lit(r"\[UNIMOD:\d+\]"), F.lit(0))


def encode(tokens: Column, vocab: list[str], add_eos: bool = False, pad_length: int | None = None) -> Column:
    """Indices of the tokens; an unknown token stops the job. Padding stands on the right."""
    index = map_of({t: i for i, t in enumerate(vocab)})
    out = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), F.raise_error(F.concat(F.lit("unknown residue "), t)).cast("int")))
    if add_eos:
        out = F.concat(out, F.array(F.lit(vocab.index(EOS))))
    if pad_length is not None:
        out = F.concat(out, F.array_repeat(F.lit(vocab.index(PAD)), F.greatest(F.lit(0), F.lit(pad_length) - F.size(out))))
    return out


def decode(indices: Column, vocab: list[str], reverse: bool = False) -> Column:
    """Tokens up to the end mark, without start marks and padding."""
    names = F.array(*[F.lit(t) for t in vocab])
    stop = F.array_position(indices, vocab.index(EOS)).cast("int")
    upto = F.when(stop > 0, F.slice(indices, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(indices)
    out = F.transform(F.filter(upto, lambda i: i > 1), lambda i: F.get(names, i))
    return F.reverse(out) if reverse else out


def encode_target(tokens: Column, vocab: list[str]) -> Column:
    """The last residue first, then the end mark: what an autoregressive model is asked for."""
    return encode(F.reverse(tokens), vocab, add_eos=True)


def encode_fixed(tokens: Column, vocab: list[str], length: int = 40) -> Column:
    """The first `length` tokens in order, padded to that length: what a refinement model is asked for."""
    return encode(F.slice(tokens, 1, length), vocab, pad_length=length)
