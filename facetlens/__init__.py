"""facetlens: labelled-vector and experiment analytics as Spark DataFrame operators."""
