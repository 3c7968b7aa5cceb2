"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

``exact_dedup``  composable polynomial fingerprints        ``simhash``   pigeonring SimHash linking
``shards``       hierarchical weighted hash tree (native)  ``mixing``    hierarchical token budgets
``token_files``  token ids in Parquet list columns         ``packing``   configuration LP packing
``quality``      ordinal cumulative-link classifier        ``language``  segmentation-marginalised language id
``ngram_lm``     weighted backoff automaton                ``codes``     rotated one-bit nearest neighbours
``merkle``       Merkle manifest over intervals        ``negatives``   hard negatives by segment summaries
``licenses``     positional index of rare words
``queries``      the registered queries and their oracle SQL
"""
