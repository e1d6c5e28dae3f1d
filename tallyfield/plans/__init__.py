"""Questions put together from the operators."""
