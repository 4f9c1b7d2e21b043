"""Where rows and documents come from, and the store that keeps committed tables."""
