"""Training-corpus operators: sharding, dedup, decontamination, classifiers, archives, packing."""
