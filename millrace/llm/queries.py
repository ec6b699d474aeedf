"""The registered queries of this package: (spark, folder) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import bpe, chat, decontaminate, licences, lines, pii, quality, secret_scan, simhash, spelling, suffixes, warc, whitening
from millrace.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


def op2_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_chat(spark, folder):
    return chat.conversation_digests(chat.with_probe(table(spark, folder, "conversations")))


def op4_lines(spark, folder):
    return lines.line_repeats(table(spark, folder, "documents"), passage_words=lines.PASSAGE_WORDS)


def op5_bpe(spark, folder):
    return bpe.round_trip_digests(table(spark, folder, "documents"), tokenizer_path())


def op6_licences(spark, folder):
    return licences.licence_labels(table(spark, folder, "documents"))


def op7_suffixes(spark, folder):
    return suffixes.without_repeats(table(spark, folder, "documents"))


def op8_quality(spark, folder):
    return quality.verdicts(table(spark, folder, "documents"))


def op9_warc(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


def op10_decontaminate(spark, folder):
    return decontaminate.find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_spelling(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_whitening(spark, folder):
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


def op13_secrets(spark, folder):
    return secret_scan.secrets(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_simhash, op3_chat, op4_lines, op5_bpe, op6_licences, op7_suffixes, op8_quality, op9_warc, op10_decontaminate,
        op11_spelling, op12_whitening, op13_secrets,
    )
}
ORACLES = {"op3_chat": chat.SQL, "op9_warc": warc.SQL}
