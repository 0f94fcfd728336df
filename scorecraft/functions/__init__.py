"""Column-expression helpers and the few Arrow-batched UDFs."""
