"""DataFrame -> DataFrame operators.  No operator runs an action unless its docstring says so."""
