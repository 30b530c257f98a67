"""DataFrame -> DataFrame jobs. Every function is lazy: it only builds a plan."""
