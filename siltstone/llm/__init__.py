"""Training-data operators. Nothing else in siltstone imports this subpackage.

minhash (1), rules (2), packing (3), decontam (4), passages (5), sstable (6),
shards (7), ordinal (8), langid (9), suffixes (10), lexical (11), rolling (12),
ledger (13).
"""
