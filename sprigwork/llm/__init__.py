"""Operators on free text and near-identical records. Nothing outside this folder imports it."""
