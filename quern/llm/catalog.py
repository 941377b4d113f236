"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quern.llm import decontaminate, divergence, imatch, language, ngramjoin, rankedsearch, secretscan, sentencepieces, tokenshards, toxicity, urlblocks, warc, wordbpe

QUERIES = {
    "op1_url_redirects": urlblocks.op1_url_redirects,
    "op2_imatch": imatch.op2_imatch,
    "op3_secret_scan": secretscan.op3_secret_scan,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language_id": language.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_shards": tokenshards.op8_token_shards,
    "op9_warc": warc.op9_warc,
    "op10_ngram_join": ngramjoin.op10_ngram_join,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_ranked_search": rankedsearch.op12_ranked_search,
    "op13_word_bpe": wordbpe.op13_word_bpe,
    "ledger_increments": secretscan.ledger_increments,
    "redirect_components": urlblocks.redirect_components,
}

ORACLES: dict[str, str] = {
    "op1_url_redirects": urlblocks.ORACLE,
    "op3_secret_scan": secretscan.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_ranked_search": rankedsearch.ORACLE,
    "ledger_increments": secretscan.INCREMENTS_ORACLE,
    "redirect_components": urlblocks.CHAINS_ORACLE,
}
