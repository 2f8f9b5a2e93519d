"""Queries of the operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from graphloom.llm import op1_html_text, op2_token_counts, op3_lattice, op4_token_files, op5_language_id, op6_byte_bpe, op7_ball_tree, op8_mixing, op9_pii, op10_simhash

MODULES = (op1_html_text, op2_token_counts, op3_lattice, op4_token_files, op5_language_id, op6_byte_bpe, op7_ball_tree, op8_mixing, op9_pii, op10_simhash)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
