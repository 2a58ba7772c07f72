"""DataFrame to DataFrame steps of an audit."""
