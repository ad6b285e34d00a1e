"""Plan building blocks shared by the operators: skew handling and lineage cuts."""
