"""Scriptorium: a Spark-first analytics engine for notes, dialogues and event streams."""
