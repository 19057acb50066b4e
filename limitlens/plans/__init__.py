"""Plan shapes shared by the operators: checked broadcasts, salted joins, pruned top-n."""
