"""DataFrame to DataFrame operators. Lazy: nothing here runs a job unless its docstring says so."""
