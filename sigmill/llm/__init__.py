"""Operators of a training-data pipeline over `documents`-like tables.

Nothing outside this subpackage imports it.  Modules:

* ``line_dedup``    fuzzy line deduplication (SimHash, pigeonhole blocks)
* ``language_id``   byte convolutional language identification
* ``decontaminate`` benchmark decontamination (pigeonhole pieces, Myers)
* ``mixing``        weighted fair queueing to target weights (native)
* ``secrets``       Markov-model secret scan (native)
* ``sharding``      balanced label propagation (native)
* ``near_dedup``    DartMinHash near-duplicate classes
* ``exact_dedup``   minimal perfect hash over historical digests
* ``token_counts``  edit-aware token counts on segment trees
* ``url_filters``   URL rules plus trust and distrust propagation
* ``whitening``     whitening of embeddings by computeSVD on centred rows
* ``quality``       Bradley-Terry ranking of texts by preference pairs
* ``divergence``    divergence of sources by joint histograms of counts
"""
