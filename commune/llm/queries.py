"""The registered queries of this subpackage, and their plain SQL where SQL can express them."""

from __future__ import annotations

from commune.llm import (chat, decontaminate, licenses, linededup, pieces, polyhash, prefixtrie, quality, simhash, toxicity,
                         urltree, warc, whitening)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_chat_formatting": chat.query,
    "op4_license_scans": licenses.query,
    "op5_url_filters": urltree.query,
    "op6_sentencepiece": pieces.query,
    "op7_warc": warc.query,
    "op8_quality_classifier": quality.query,
    "op9_document_fingerprints": polyhash.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_conversation_trie": prefixtrie.query,
    "op12_embedding_whitening": whitening.query,
    "op13_line_dedup": linededup.query,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_conversation_trie": prefixtrie.ORACLE_SQL,
    "op13_line_dedup": linededup.ORACLE_SQL,
}
