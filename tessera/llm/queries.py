"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import alignment, byte_bpe, fingerprint, flac, hosts, jaccard, lm, mixing, packing, quality, toxicity, warc, whitening
from tessera.llm.store import table

QUERIES = {
    "op1_fingerprint": lambda s, d: fingerprint.edited_fingerprints(table(s, d, "documents")),
    "op2_hosts": lambda s, d: hosts.judged(table(s, d, "pages")),
    "op3_quality": lambda s, d: quality.classified(table(s, d, "documents"), table(s, d, "labels")),
    "op4_flac": lambda s, d: flac.text_media(table(s, d, "documents")),
    "op5_jaccard": lambda s, d: jaccard.classes(table(s, d, "documents")),
    "op6_lm": lambda s, d: lm.held_out_scores(table(s, d, "documents")),
    "op7_packing": lambda s, d: packing.pieces(table(s, d, "documents")),
    "op8_toxicity": lambda s, d: toxicity.classified(table(s, d, "documents"), table(s, d, "labels")),
    "op9_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op10_mixing": lambda s, d: mixing.decisions(table(s, d, "documents")),
    "op11_alignment": lambda s, d: alignment.aligned(table(s, d, "documents")),
    "op12_whitening": lambda s, d: whitening.whitened(table(s, d, "embeddings")),
    "op13_byte_bpe": lambda s, d: byte_bpe.round_trip(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op9_warc": warc.ORACLE,
}
