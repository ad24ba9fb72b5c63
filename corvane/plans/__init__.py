"""The query surface: dialect, results, tools and the engine that ties them together."""
