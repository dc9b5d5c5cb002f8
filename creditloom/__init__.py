"""creditloom: credit-risk feature, graph and evaluation jobs written as Spark DataFrame plans."""
