"""Log-evidence analytics on Spark.

Every public function takes and returns DataFrames or Columns; nothing here
runs an action unless its docstring says so.
"""
