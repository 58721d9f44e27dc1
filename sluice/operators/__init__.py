"""The commands as functions (DataFrame, Command, Context) -> DataFrame."""
