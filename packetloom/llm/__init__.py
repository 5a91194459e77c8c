"""Operators for large training corpora. Nothing outside this package imports it.

Conventions that hold for every operator here
---------------------------------------------
* Inputs are DataFrames, outputs are DataFrames; extra input columns never clash with
  working columns, because operators first project what they need under private names.
* A null text counts as the empty text unless a docstring says otherwise. Empty tables
  give empty results with the same schema. Exactly repeated rows are the same document
  and get the same decision.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (see ``_store``),
  which cuts lineage and survives lost executors.
"""
