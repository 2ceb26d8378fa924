"""Inference for network-dependent data, expressed as Spark DataFrame plans."""
