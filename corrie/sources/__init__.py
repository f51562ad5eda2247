"""Where tables come from: the snapshot store and tables registered from outside."""
