"""The registered query of each operator, on its whole table with production parameters."""

from __future__ import annotations

from . import decontam, langid, ledger, lexical, minhash, oracles, ordinal, packing, passages, rolling, rules, shards, sstable, suffixes
from .common import prepare, table


def _docs(spark, sf_dir):
    return table(prepare(spark), sf_dir, "documents")


def op1_circulant_minhash(spark, sf_dir):
    return minhash.op1(_docs(spark, sf_dir))


def op2_isolation_rules(spark, sf_dir):
    return rules.op2(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_mixture_packing(spark, sf_dir):
    return packing.op3(_docs(spark, sf_dir))


def op4_prefix_decontamination(spark, sf_dir):
    return decontam.op4(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_chained_passages(spark, sf_dir):
    return passages.op5(_docs(spark, sf_dir))


def op6_token_sstable(spark, sf_dir):
    return sstable.op6(_docs(spark, sf_dir))


def op7_lpt_shards(spark, sf_dir):
    return shards.op7(_docs(spark, sf_dir))


def op8_ordinal_quality(spark, sf_dir):
    return ordinal.op8(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_viterbi_language(spark, sf_dir):
    return langid.op9(_docs(spark, sf_dir))


def op10_suffix_merge(spark, sf_dir):
    return suffixes.op10(_docs(spark, sf_dir))


def op11_wand_search(spark, sf_dir):
    return lexical.op11(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_rolling_median(spark, sf_dir):
    return rolling.op12(table(spark, sf_dir, "clicks"))


def op13_blob_ledger(spark, sf_dir):
    return ledger.op13(_docs(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
